"""Small awkward tables: nulls everywhere, empty and long texts, copies, ties, clashing columns."""

import random
import re

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long,"
    " score double, size int, row long, uid string, kept string, token string, label string, n int, spans string"
)
_SYLLABLES = {
    "en": "the of and ing ed re th on er st an in ha nd sh ly".split(),
    "de": "der die und ung sch ein ich keit heit ver ge be ü ß".split(),
    "fr": "le la et que tion eau eux ai ou é è re en ment".split(),
}


def words(rng, lang, n):
    parts = _SYLLABLES[lang]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(n)]


def prose(rng, lang, n):
    out, left = [], n
    while left > 0:
        k = min(left, rng.randrange(5, 30))
        out.append(" ".join(words(rng, lang, k)).capitalize() + ".")
        left -= k
    return "\n".join(out)


def texts(seed=1, originals=24):
    """Originals, exact and near copies, shared passages and lines, junk."""
    rng = random.Random(seed)
    langs = list(_SYLLABLES)
    base = [(prose(rng, langs[i % 3], rng.randrange(30, 160)), langs[i % 3]) for i in range(originals)]
    out = list(base)
    passage = " ".join(words(rng, "en", 70))
    line = "All rights of this site are kept, 2024."
    for text, lang in base[:6]:
        out.append((text, lang))
    for text, lang in base[6:14]:
        w = text.split(" ")
        for _ in range(3):
            copy = list(w)
            copy[rng.randrange(len(copy))] = "changed"
            out.append((" ".join(copy), lang))
    for i in range(5):
        out.append((prose(rng, "en", 40) + "\n" + passage + "\n" + prose(rng, "en", 30), "en"))
    for i in range(8):
        out.append((line + "\n" + prose(rng, "en", 25) + "\n" + line.upper(), "en"))
    out.append(("BUY NOW!! " * 40, "en"))
    out.append(("### $$$ %%% | & < > " * 12, None))
    out.append(("12345 67890 -- 5", "en"))
    out.append(("x", "en"))
    return out


def rows():
    found = []
    for i, (text, lang) in enumerate(texts()):
        found.append((i * 3 + 1, text, lang, f"host{i % 3}" if i % 7 else None, len(text)))
    found += [
        (1000, None, "en", "host1", None), (1001, "", "de", "host1", 0), (1002, " \n\t\n ", None, "host2", 5),
        (None, texts()[3][0], "en", "host0", 1), (None, None, None, None, None),
        (1003, texts(5)[0][0], "en", "host0", 9), (1003, texts(5)[0][0], "en", "host0", 9),
        (1004, texts(6)[1][0], "de", "host0", 9), (1004, texts(7)[1][0], "de", "host0", 9),
        (-5, prose(random.Random(8), "fr", 9000), "fr", "", 3),
    ]
    return [(*r, 0.5, 7, 9, "u", "k", "t", "l", 3, "s") for r in found]


def frame(spark, data=None):
    """The rows over several partitions."""
    return spark.createDataFrame(rows() if data is None else data, SCHEMA).repartition(3)


def lower(text):
    return (text or "").translate({i: i + 32 for i in range(65, 91)})


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def collected(df, *columns):
    """Rows in an order of their own."""
    out = [tuple(r[c] for c in columns) for r in df.select(*columns).collect()]
    return sorted(out, key=repr)
