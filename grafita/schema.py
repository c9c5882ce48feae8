"""The property graph's schema as data: small tables that the checks join with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Field, type and whether it is required, by label.
LABEL_FIELDS = {
    "Proyecto": (("titulo", "str", True), ("titulo_de_despliegue", "str", True), ("palabras_clave", "list", False), ("descripcion", "str", False)),
    "Grupo": (("titulo", "str", True), ("titulo_de_despliegue", "str", True), ("palabras_clave", "list", False), ("descripcion", "str", False)),
    "Anio": (("anio", "str", True),),
    "Investigador": (("nombre", "str", True), ("nombre_de_despliegue", "str", True), ("documento", "str", False), ("tipo_documento", "str", False), ("pais_documento", "str", False), ("sexo", "str", False)),
    "Documento": (("nombre_base", "str", True), ("es_grupo", "str", True), ("anio_publicacion", "str", True), ("sub_id", "str", False), ("tipo", "enum", True)),
    "Topico": (("valor", "str", True),),
    "Subcampo": (("valor", "str", True),),
    "Area": (("valor", "str", True),),
    "Chunk": (("texto", "str", True), ("paginas", "list", True)),
}
#: The kinds of document.
DOCUMENT_KINDS = ("informe", "propuesta", "resumen", "tabla")
#: Source labels, target labels, least and most edges from a source (-1: any number).
EDGE_RULES = {
    "PARTICIPO_EN": (("Investigador",), ("Proyecto", "Grupo"), 1, -1),
    "TIENE_TOPICO": (("Proyecto", "Grupo"), ("Topico",), 1, -1),
    "PERTENECE_A_SUBCAMPO": (("Topico",), ("Subcampo",), 1, -1),
    "PERTENECE_A_AREA": (("Proyecto", "Grupo"), ("Area",), 0, 1),
    "ES_DESCRITO_POR": (("Proyecto", "Grupo"), ("Documento",), 1, -1),
    "INICIO_EN": (("Proyecto", "Grupo"), ("Anio",), 1, 1),
    "PRIMER_CHUNK": (("Documento",), ("Chunk",), 1, 1),
    "SIGUIENTE_CHUNK": (("Chunk",), ("Chunk",), 0, 1),
    "DE_DOCUMENTO": (("Chunk",), ("Documento",), 1, 1),
    "EXTRAIDO_DE": (("Chunk",), ("Topico", "Investigador"), 0, -1),
    "TITULO_EXTRAIDO_DE": (("Proyecto", "Grupo"), ("Chunk",), 0, -1),
}


def label_fields(spark: SparkSession) -> DataFrame:
    """label, field, type, required."""
    return spark.createDataFrame([(label, *f) for label, fields in LABEL_FIELDS.items() for f in fields], "label string, field string, type string, required boolean")


def edge_endpoints(spark: SparkSession) -> DataFrame:
    """type, src_label, dst_label: the legal ends."""
    return spark.createDataFrame([(t, s, d) for t, (ss, ds, _, _) in EDGE_RULES.items() for s in ss for d in ds], "type string, src_label string, dst_label string")


def edge_cardinality(spark: SparkSession) -> DataFrame:
    """src_label, type, least, most (null: any number); rules that allow anything are left out."""
    rows = [(s, t, low, None if high < 0 else high) for t, (ss, _, low, high) in EDGE_RULES.items() for s in ss if (low, high) != (0, -1)]
    return spark.createDataFrame(rows, "src_label string, type string, least int, most int")
