"""Column functions that normalise names, paths and texts."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

_TILDE = "\u0303"
#: Code points that may have a decomposition or be a mark; planes 4 to 13 have none.
_RANGES = (range(0x80, 0xD800), range(0xE000, 0x32400), range(0xE0000, 0xE0200))
_HANGUL = range(0xAC00, 0xD7A4)


def _without_marks(s: str, form: str, mark: Callable[[str], bool]) -> str:
    """s decomposed, without its marks other than tildes, composed again."""
    return unicodedata.normalize("NFC", "".join(c for c in unicodedata.normalize(form, s) if c == _TILDE or not mark(c)))


@lru_cache
def _folding(form: str) -> tuple[str, str, dict[str, str], dict[str, str]]:
    """What one character becomes, from the Unicode data (NFD: marks of category Mn go, NFKD: all that combine).

    Characters that become one, then those that go, as a translation; those that become
    several; and pairs of what stays that compose to one, such as n and a tilde.
    """
    mark = (lambda c: unicodedata.category(c) == "Mn") if form == "NFD" else (lambda c: unicodedata.combining(c) > 0)
    one, gone, several, pairs = {}, [], {}, {}
    for i in (i for r in _RANGES for i in r if i not in _HANGUL):
        c = chr(i)
        parts = unicodedata.decomposition(c)
        if not parts and not unicodedata.combining(c) and unicodedata.category(c) != "Mn":
            continue
        to = _without_marks(c, form, mark)
        if to == "":
            gone.append(c)
        elif len(to) == 1 and to != c:
            one[c] = to
        elif to != c:
            several[c] = to
        pair = unicodedata.normalize("NFD", c) if parts and not parts.startswith("<") else ""
        if len(pair) == 2 and to == c and not (mark(pair[1]) and pair[1] != _TILDE):
            pairs[pair] = c
    pairs |= {unicodedata.normalize("NFD", x): x for x in map(str.upper, list(pairs.values())) if len(unicodedata.normalize("NFD", x)) == 2}
    return "".join([*one, *gone]), "".join(one.values()), several, pairs


def _any_of(chars: Iterable[str]) -> str:
    """A pattern of any of the characters."""
    return "[" + "".join(f"\\x{{{ord(c):X}}}" for c in sorted(set(chars))) + "]"


def _stripped(s: Column, letters: tuple[str, str, dict[str, str]], pairs: dict[str, str]) -> Column:
    """s without marks but tildes, composed; equal to decomposing, dropping marks and composing the whole text.

    Nearly all characters are translated one for one.  Texts that hold one that becomes
    several, or the latter half of a pair that composes, take a slower way.  Jamo that stand
    apart are not composed to Hangul.
    """
    source, target, several = letters
    plain = F.translate(s, source, target)
    if several:
        table = F.create_map(*[F.lit(x) for kv in several.items() for x in kv])
        each = F.transform(F.split(s, ""), lambda c: F.coalesce(F.try_element_at(table, c), F.translate(c, source, target)))
        plain = F.when(s.rlike(_any_of(several)), F.array_join(each, "")).otherwise(plain)
    composed = plain
    for pair, to in pairs.items():
        composed = F.replace(composed, F.lit(pair), F.lit(to))
    return F.when(s.rlike(_any_of(p[1] for p in pairs)), composed).otherwise(plain)


def fold(s: Column) -> Column:
    """Lower case, marks off, tildes kept: n with a tilde stays one letter, composed or not."""
    *letters, pairs = _folding("NFD")
    return _stripped(F.lower(s), tuple(letters), pairs)


def taxonomy_id(s: Column) -> Column:
    """fold, then spaces and slashes to underscores, commas off."""
    return F.translate(F.replace(fold(s), F.lit(","), F.lit("")), " /", "__")


@lru_cache
def _id_letters() -> tuple[str, str, dict[str, str]]:
    """The compatible folding, of whose longer results only a-z0-9 matters."""
    source, target, several, _ = _folding("NFKD")
    reduced = {c: re.sub("[^a-z0-9]+", "_", t) for c, t in several.items()}
    single = [c for c, t in reduced.items() if t == "_"]
    one = source[: len(target)] + "".join(single)
    return one + source[len(target) :], target + "_" * len(single), {c: t for c, t in reduced.items() if t != "_"}


def researcher_id(country: Column, kind: Column, number: Column) -> Column:
    """country_kind_number of a-z0-9, all else one underscore, none at the ends.

    Compatible forms count as what they stand for, marks go, but a letter with a tilde is
    none of a-z, so it becomes an underscore.
    """
    flat = _stripped(F.lower(F.concat_ws("_", country, kind, number)), _id_letters(), _folding("NFKD")[3])
    return F.regexp_replace(F.regexp_replace(flat, "[^a-z0-9]+", "_"), "^_+|_+$", "")


def area_id(s: Column) -> Column:
    return F.concat(F.lit("area_"), F.replace(fold(s), F.lit(" "), F.lit("_")))


def project_id(is_group: Column, year: Column, form: Column) -> Column:
    return F.concat_ws("_", F.when(is_group, F.lit("gi")).otherwise(F.lit("proy")), year.cast("string"), form.cast("string"))


def display_name(*parts: Column) -> Column:
    """Title case, a capital after anything that is no letter."""
    whole = F.lower(F.trim(F.concat_ws(" ", *parts)))
    pieces = F.regexp_extract_all(whole, F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1))
    return F.array_join(F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), p.substr(F.lit(2), F.length(p)))), "")


def cell(s: Column) -> Column:
    """Trimmed; blank is null."""
    return F.nullif(F.trim(s), F.lit(""))


def role(s: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.trim(s)), F.lit("")), F.lit("integrante"))


_DOC = r"(?i)^(\w+?)_(\d{4})_(\w+)_([a-z]+)(?:\.pdf)?$"


def document_name(s: Column) -> Column:
    """Struct of grupo, anio, sub_id, tipo of a canonical name; nulls if it isn't one."""
    part = lambda i: F.nullif(F.regexp_extract(s, _DOC, i), F.lit(""))
    return F.struct(F.lower(part(1)).alias("grupo"), part(2).alias("anio"), part(3).alias("sub_id"), F.lower(part(4)).alias("tipo"))


def path_group(path: Column) -> Column:
    """gi, proy or empty, by the first folder."""
    top = F.lower(F.split(F.translate(path, "\\", "/"), "/")[0])
    return F.when(top.startswith("gi_") | top.contains("grupos"), "gi").when(top.startswith("proy_") | top.contains("proyectos"), "proy").otherwise("")


def document_kind(name: Column) -> Column:
    """informe, propuesta, resumen, in this order; else null (C11)."""
    low = F.lower(name)
    return F.when(low.contains("informe"), "informe").when(low.contains("propuesta"), "propuesta").when(low.contains("resumen"), "resumen")


def kind_position(name: Column) -> Column:
    """Where the first kind word begins, from 0; null without one."""
    low = F.lower(name)
    return F.least(*[F.nullif(F.locate(k, low), F.lit(0)) for k in ("informe", "propuesta", "resumen")]) - 1


def narrative(name: Column) -> Column:
    """narrative if a kind is present, else tabular."""
    return F.when(document_kind(name).isNotNull(), "narrative").otherwise("tabular")


def relevant_year(path: Column) -> Column:
    """The year of a path's folders.

    From the last all-digit folder back to the first folder with exactly one year (20dd);
    failing that the last folder with exactly one year and its first kind word after it;
    failing that the first folder with exactly one year; else unknown.
    """
    parts = F.split(F.translate(path, "\\", "/"), "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    years = lambda f: F.regexp_extract_all(f, F.lit(r"(20\d\d)"), F.lit(1))
    digits = F.array_max(F.filter(F.transform(folders, lambda f, i: F.when(f.rlike(r"^\d+$"), i)), lambda i: i.isNotNull()))
    marked = F.transform(folders, lambda f, i: F.struct(i.alias("i"), years(f).alias("y"), F.lower(f).rlike(r"^((?!informe|propuesta|resumen).)*20\d\d.*(informe|propuesta|resumen)").alias("k")))
    single = F.filter(marked, lambda m: F.size(m["y"]) == 1)
    above = F.filter(single, lambda m: m["i"] < digits)
    preferred = F.filter(single, lambda m: m["k"])
    pick = lambda a: F.get(F.get(F.reverse(a), F.lit(0))["y"], F.lit(0))
    return F.coalesce(F.when(digits.isNotNull(), pick(above)), pick(preferred), F.get(F.get(single, F.lit(0))["y"], F.lit(0)), F.lit("unknown"))


def path_form_id(path: Column) -> Column:
    """The last all-digit folder; null without one."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    return F.get(F.reverse(F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda f: f.rlike(r"^\d+$"))), F.lit(0))


def canonical_name(path: Column) -> Column:
    """{prefix}_{year}_{id}_{kind}.ext, a table's or an administrative name, or the invalid mark (C14)."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    name = F.element_at(parts, -1)
    ext = F.lower(F.regexp_extract(name, r"(\.[^.]*)$", 1))
    folders = F.concat_ws("/", F.slice(parts, 1, F.size(parts) - 1))
    prefix, year, form = path_group(path), relevant_year(path), path_form_id(path)
    kind = F.coalesce(document_kind(name), document_kind(folders))
    table = kind.isNull() & ext.isin(".xlsx", ".csv")
    return (
        F.when((prefix != "") & form.isNotNull() & kind.isNotNull(), F.concat(F.concat_ws("_", prefix, year, form, kind), ext))
        .when((prefix != "") & table, F.concat(F.concat_ws("_", prefix, year, F.lit("table")), ext))
        .when((prefix == "") & (year != "unknown"), F.concat_ws("_", F.lit("admin"), year, name))
        .otherwise("invalid_path_structure.pdf")
    )


def path_project_key(path: Column) -> Column:
    """year_form of proyectos YYYY/.../digits/...; null otherwise."""
    year = F.nullif(F.regexp_extract(F.lower(path), r"^proyectos[_ ](\d{4})/", 1), F.lit(""))
    parts = F.split(path, "/")
    form = F.get(F.filter(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), lambda f: f.rlike(r"^\d+$")), F.lit(0))
    return F.when(year.isNotNull() & form.isNotNull(), F.concat_ws("_", year, form))


def valid_project_path(path: Column) -> Column:
    return path_project_key(path).isNotNull()


def strip_label(s: Column) -> Column:
    return F.regexp_replace(s, r"^T?\d+: ", "")


def collapsed(s: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(s, r"\s+", " ")))


def _scalar(x: Column) -> Column:
    return F.lower(F.trim(x.cast("string")))


def comparable(value: Column, kind: str = "map") -> Column:
    """Text of a value to compare by: of a map whatever its order, of a list in its order, of a scalar trimmed and lower-cased; null is empty.

    kind: map, list or scalar.  Null items and values are empty, too.
    """
    blank = lambda x: F.coalesce(_scalar(x), F.lit(""))
    if kind == "map":
        text = F.array_join(F.transform(F.array_sort(F.map_entries(value)), lambda e: F.concat_ws("=", blank(e["key"]), blank(e["value"]))), ";")
    elif kind == "list":
        text = F.concat(F.lit("["), F.array_join(F.transform(value, blank), ";"), F.lit("]"))
    else:
        text = _scalar(value)
    return F.coalesce(text, F.lit(""))


def entity_key(label: Column, id_: Column, value: Column) -> Column:
    """What two entities are the same by: some labels' id, others' value (C20)."""
    return F.concat_ws(":", label, F.when(label.isin("Proyecto", "Grupo", "Documento", "Chunk"), id_).otherwise(F.lower(F.trim(value))))


def props_key(label: Column, id_: Column, props: Column) -> Column:
    """As entity_key, with the value taken from a node's properties: a researcher's nombre, a year's anio, else all of them (C20)."""
    named = F.when(label == "Investigador", _scalar(props["nombre"])).when(label == "Anio", _scalar(props["anio"]))
    by_id = label.isin("Proyecto", "Documento", "Chunk")
    return F.concat_ws(":", label, F.when(by_id, id_).when(label.isin("Investigador", "Anio"), F.coalesce(named, F.lit(""))).otherwise(comparable(props)))


def edge_key(kind: Column, source: Column, target: Column) -> Column:
    """What two edges are the same by (C20)."""
    return F.concat_ws("|", kind, source, target)


def counting(s: Column) -> Column:
    return F.coalesce(F.lower(s).rlike("cantidad|frecuencia|total|count"), F.lit(False))


def unit_score(s: Column) -> Column:
    """A score from 1 to 5 as 0 to 1."""
    return (F.greatest(F.lit(1.0), F.least(F.lit(5.0), s.cast("double"))) - 1) / 4


def ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def primary_label(labels: Column, known: list[str]) -> Column:
    return F.coalesce(F.get(F.filter(labels, lambda x: x.isin(known)), F.lit(0)), F.get(labels, F.lit(0)), F.lit("Entidad"))


#: The properties that a label's display comes from, the first that isn't blank; other labels take id, valor.
DISPLAY_FIELDS = {
    "Investigador": ("nombre_de_despliegue", "nombre", "id"),
    "Proyecto": ("titulo_de_despliegue", "titulo", "id"),
    "Grupo": ("titulo_de_despliegue", "titulo", "id"),
    "Topico": ("valor", "id"),
    "Anio": ("anio", "id"),
}
#: The properties that name a node of any label in a text.
MENTION_FIELDS = ("valor", "nombre_de_despliegue", "titulo_de_despliegue", "nombre", "titulo", "id")


def _first_of(names: tuple[str, ...], props: Column, id_: Column, default: Column) -> Column:
    return F.coalesce(*[F.nullif(id_ if n == "id" else props[n], F.lit("")) for n in names], default)


def display_value(label: Column, props: Column, id_: Column) -> Column:
    """What a node is shown as: its label's properties in turn, at last the label."""
    shown = F.lit(None).cast("string")
    for name, fields in DISPLAY_FIELDS.items():
        shown = F.when(label == name, _first_of(fields, props, id_, label)).otherwise(shown)
    return F.coalesce(shown, _first_of(("id", "valor"), props, id_, label))


def mention(label: Column, props: Column, id_: Column) -> Column:
    """A node in a text: its first name, then its label in brackets."""
    return F.concat(_first_of(MENTION_FIELDS, props, id_, F.lit("")), F.lit(" ("), label, F.lit(")"))
