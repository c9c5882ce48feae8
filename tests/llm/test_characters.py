"""Characters out of UTF-8, lower-cased, against Python."""

import numpy as np
import pyarrow as pa

from grafita.llm import toxicity
from grafita.llm.textkit import texts_of


def test_characters_of_texts():
    texts = ["ÑANDÚ Straße", "", None, "日本語😀Ω", "a", "ÀÉĞŞ𐐀z", "ﬁ"]
    point, offsets = toxicity.characters(*texts_of(pa.array(texts)))
    for i, t in enumerate(texts):
        assert "".join(map(chr, point[offsets[i] : offsets[i + 1]])) == (t or "").lower()
    assert len(toxicity.characters(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0]) == 0


def test_n_grams_are_of_characters():
    space = toxicity.NgramSpace((2,), 20)
    data, offsets = texts_of(pa.array(["éö", "ÉÖ", "日本", "abc"]))
    doc, slot = space.present(data, offsets)
    assert np.bincount(doc, minlength=4).tolist() == [1, 1, 1, 2]
    assert slot[doc == 0] == slot[doc == 1]
