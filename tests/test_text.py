"""Text functions against plain Python."""

import hashlib
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane.functions import text
from corvane.functions.stem import stem

TEXTS = [None, "", "  ", "Ёлка — ЁЖ!", "ﬁne ½ №5", "Naïve Straße", "a_b-c", "Ⅷ Ａｂ", "ıI", "x" * 3000, "купить квартиру в Москве 2к"]


def slow_normalize(t):
    t = unicodedata.normalize("NFKC", t or "").lower().replace("ё", "е")
    return re.sub(r"[^0-9a-zа-яё]+", " ", t, flags=re.I).strip()


def of(spark, column):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS)], "k long, t string")
    return [r[0] for r in frame.select("k", column.alias("v")).orderBy("k").select("v").collect()]


def test_normalize(spark):
    assert of(spark, text.normalize_text(F.col("t"))) == [slow_normalize(t) for t in TEXTS]


def test_tokens_and_lengths(spark):
    assert of(spark, text.tokens(text.normalize_text(F.col("t")))) == [slow_normalize(t).split() for t in TEXTS]


def test_fold_is_the_hash_modulo(spark):
    expected = [int.from_bytes(hashlib.sha256(slow_normalize(t).encode()).digest()[:8], "big") % 5 for t in TEXTS]
    assert of(spark, text.stable_fold(text.normalize_text(F.col("t")), 5)) == expected


def test_stable_rank_reads_null_as_none(spark):
    expected = [hashlib.sha256(f"s\x1e{t}\x1f7".encode()).hexdigest() for t in TEXTS]
    assert of(spark, text.stable_rank("s", F.col("t"), F.lit(7))) == expected


def slow_char_grams(tokens):
    out = []
    for w in (f" {t} " for t in tokens):
        for n in (3, 4, 5):
            out += [w[k : k + n] for k in range(max(1, len(w) - n + 1))]
            if len(w) <= n:
                break
    return sorted(out)


def test_grams(spark):
    tokens = [slow_normalize(t).split()[:20] for t in TEXTS if len(t or "") < 100]
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(tokens)], "k long, t array<string>").select("k", text.word_grams(F.col("t")).alias("w"), text.char_grams(F.col("t")).alias("c")).orderBy("k")
    for t, r in zip(tokens, frame.collect(), strict=True):
        assert sorted(r["w"]) == sorted(t + [f"{a} {b}" for a, b in zip(t, t[1:])])
        assert sorted(r["c"]) == slow_char_grams(t)


@pytest.mark.parametrize("word,expected", [("важная", "важн"), ("важнейший", "важн"), ("квартиры", "квартир"), ("новостью", "новост"), ("делаешь", "дела"), ("12", "12"), ("word", "word"), ("в", "в")])
def test_stems(word, expected):
    assert stem(word) == expected


def test_dense_texts(spark):
    frame = spark.createDataFrame([("  A   b ", None, "x" * 400), ("q", " p\n", None)], "t string, p string, d string")
    got = [tuple(r) for r in frame.select(text.dense_query_text(F.col("t"), F.col("p")), text.dense_item_text(F.col("t"), F.col("p"), F.col("d"))).collect()]
    assert got == [("a b", "A b |  | " + "x" * 300), ("q | p", "q | p | ")]


def test_characters_that_stay_out_of_python_are_never_changed():
    """Every character outside the class is in NFKC by itself and beside any other such."""
    import re
    import unicodedata

    from corvane.functions import text

    inside = [(int(a, 16), int(b, 16)) for a, b in re.findall(r"\\x\{(\w+)\}-\\x\{(\w+)\}", text._CHANGEABLE)]
    safe = [chr(c) for c in range(0x3000) if not any(a <= c <= b for a, b in inside)]
    assert inside[-1][1] == 0x10FFFF and len(safe) > 900 and {*"éßñ»’ёяΩ€"} <= {*safe} and not {*"½\u00a0ﬁ…\u0301"} & {*safe}
    assert all(unicodedata.is_normalized("NFKC", a + b) for a in safe for b in safe)


def test_letters_of_other_scripts_end_words_as_before(spark):
    from pyspark.sql import functions as F

    from corvane.functions import text

    rows = [("Ёж é ï ñandú",), ("straße 𝒳 x\U0001f600y",), ("İı ᲀ һ ѐ",), ("½ ﬁ e\u0301",)]
    got = spark.createDataFrame(rows, "t string").select(text.normalize_text(F.col("t")).alias("n"), text.folded(F.col("t")).alias("f")).collect()
    import unicodedata

    assert [r["f"] for r in got] == [unicodedata.normalize("NFKC", t) for (t,) in rows]
    assert [r["n"] for r in got][0] == "еж and"[:2] + " andú"[:4] and got[1]["n"] == "stra e x x y" and got[2]["n"].split()[-1] == "ᲀ" and got[3]["n"] == "1 2 fi"


def test_the_look_ahead_changes_nothing(spark):
    c = F.col("c")
    found = spark.range(0x30000).where("id < 55296 or id > 57343").select(F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    assert found.where(c.rlike(text._CHANGED) != c.rlike(text._CHANGEABLE)).count() == 0 and found.where(c.rlike(text._CHANGED)).count() > 100_000


def test_texts_of_an_arrow_batch_are_normalised_as_columns(spark):
    """Each plain character alone and between letters, odd texts, nulls and runs; what is left to Spark comes out the same."""
    import pyarrow as pa

    from corvane.operators import packed

    steady = [chr(c) for c in text._steady()]
    texts = [*TEXTS, *steady, *[f"aБ{c}я{c}  Z" for c in steady], "ΑΣ ΣΑΣ", "İstanbul", "é x", "a  b\n\nc -- d", "- a -", "\U0001f600" * 3, "1 2", "x y" * 700 + "Σ" * 400]
    plain = text.normalized_plain(pa.array(texts, pa.string()))
    assert plain.null_count < 20 and {texts[k] for k in range(len(texts)) if not plain[k].is_valid} >= {"ﬁne ½ №5", "Σ", "İ", "İstanbul", "é x", "ΑΣ ΣΑΣ"}
    raw = spark.createDataFrame([(k, t, t) for k, t in enumerate(texts)], "k long, whole string, cut string")
    for unicode in (True, False):
        n = lambda c: text.normalize_text(F.col(c), unicode)  # noqa: B023, E731
        expected = {tuple(r) for r in raw.select("k", n("whole"), F.substring(n("cut"), 1, 900)).collect()}
        made = packed.normalized(raw, {"whole": None, "cut": 900}, unicode)
        assert {tuple(r) for r in made.collect()} == expected and made.columns == raw.columns
    assert [x.as_py() for x in plain.slice(0, 4)] == ["", "", "", "елка еж"]
    assert "ArrowEvalPython" not in made._jdf.queryExecution().executedPlan().toString()
