"""Text functions against plain Python on literal and random strings; inequalities of quality scores."""

import random
import re

from pyspark.sql import functions as F

from papyra.functions import classify, language, quality, text

AL = list("ab C9é_|~.!? \n\t-—(){}x1年ñ ") + ["(cid:7)", "...", "word ", "||", "Über "]


def samples(n=150):
    rng = random.Random(7)
    return ["", " ", "a"] + ["".join(rng.choice(AL) for _ in range(rng.randrange(60))) for _ in range(n)]


def run(spark, cols, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r for r in df.select("i", *[c.alias(n) for n, c in cols.items()]).orderBy("i").collect()]


def test_against_python(spark):
    values = samples()
    c = F.col("t")
    got = run(spark, {"alpha": text.alpha_ratio(c), "cid": text.clean_cid_codes(c), "ws": text.normalize_whitespace(c), "tok": text.tokens(c), "read": text.is_readable_text(c), "fl": quality.flesch(c), "art": quality.artifact_ratio(c)}, values)
    for r, v in zip(got, values):
        letters = sum(ch.isalpha() for ch in v)
        assert abs(r.alpha - (letters / len(v) if v else 0)) < 1e-12
        assert r.cid == re.sub(r"\s+", " ", re.sub(r"\(cid:\d+\)", "", v)).strip()
        assert r.ws == re.sub(r"\n{3,}", "\n\n", re.sub(" +", " ", v)).strip()
        assert r.tok == len(v.split())
        words, sent = len(v.split()), len(re.split(r"[.!?]+", v))
        if words < 10:
            assert r.fl == 0
        else:
            syl = max(1, len(re.findall("[aeiouyAEIOUY]+", v)) - (v[-1:] in "eE" and bool(v)))
            assert abs(r.fl - max(0, min(100, 206.835 - 1.015 * words / sent - 84.6 * syl / words))) < 1e-9
        hits = sum(len(re.findall(p, v)) for p in (r"\|{2,}", "_{3,}", r"\.{3,}", r"\?{2,}", r"\b[a-z]\b", "[0-9][a-zA-Z][0-9]"))
        assert abs(r.art - (min(1, hits / len(v)) if v else 0)) < 1e-12


def test_orderings(spark):
    good = "This is a well formed paragraph. It has several sentences, and every one of them reads easily enough for the score."
    bad = "||| ___ ... a1b c d e ??? |||"
    g, b = run(spark, {"q": text.text_quality(F.col("t")), "s": quality.text_score(F.col("t")), "a": quality.artifact_ratio(F.col("t")), "c": quality.coherence(F.col("t"))}, [good, bad])
    assert g.q > b.q and g.s > b.s and g.a < b.a and g.c > b.c and all(0 <= x <= 1 for x in (g.q, b.q, g.s, b.s))


def test_normalising(spark):
    c = F.col("t")
    values = ["J O H N", "1 2 / 0 5 / 1 9 9 9", "31-12-2001", "2001/2/3", "7/4/49", "7/4/51", "02302001", "H 1 B", "F12", "no date", "13/13/2000 1-2-2003"]
    got = run(spark, {"s": text.normalize_ocr_spacing(c), "d": text.extract_date(c).cast("string"), "k": text.normalize_class_of_admission(c)}, values)
    assert [r.d for r in got] == [None, "1999-12-05", "2001-12-31", "2001-02-03", "2049-07-04", "1951-07-04", None, None, None, None, "2003-02-01"]
    assert got[0].s == "JOHN" and got[7].k == "H-1B" and got[8].k == "F-12"


def test_json_and_pairs(spark):
    c = F.col("t")
    got = run(spark, {"j": text.first_json_object(c), "kv": text.key_value(c), "js": text.json_text(c)}, ["x {\"a\": 1} y", "no", "{bad", "Name: Jo: e", "a = b", " “q” – "])
    assert got[0].j == '{"a": 1}' and got[1].j is None and got[2].j is None
    assert tuple(got[3].kv) == ("Name", "Jo: e", 0.9) and tuple(got[4].kv) == ("a", "b", 0.8) and got[1].kv is None
    assert got[5].js == '"q" -'


def test_language_scripts(spark):
    values = ["The quick brown fox", "Это русский текст", "这是中文", "هذا نص", "यह हिंदी है", None, "  "]
    got = [r.x.language for r in run(spark, {"x": language.detect(F.col("t"))}, values)]
    assert got[0] == "en" and got[1:5] == ["ru", "zh", "ar", "hi"] and got[5:] == ["unknown", "unknown"]


def test_classes(spark):
    c = F.col("t")
    kinds = run(spark, {"k": classify.decide(classify.pattern_signals(c), {})}, ["Invoice Number 7, bill to me, amount due", "nothing at all", "Form 1040, filing status, taxable income"])
    assert [r.k.document_type for r in kinds] == ["invoice", "unknown", "tax_form_1040"]


def test_nulls(spark):
    c = F.col("t")
    r = run(spark, {"a": text.alpha_ratio(c), "g": text.is_garbage_text(c), "r": text.is_readable_text(c), "n": text.extract_valid_name(c), "d": text.extract_date(c), "p": text.paragraphs(c)}, [None])[0]
    assert (r.a, r.g, r.r, r.n, r.d, r.p) == (None, True, False, None, None, None)
