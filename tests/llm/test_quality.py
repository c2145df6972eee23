import re

from fieldsense.llm import quality as Q

from . import cases


def base(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    covered = {i + k for i, x in enumerate(windows) if windows.count(x) > 1 for k in range(3)}
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))


def test_measures():
    for text in (None, "", "a b c a b c", "a a a a", "x\ny\nx\n \n \n", "a#b |c\x0b$", "é\x85b\x1cc d", "a b c d a b c e a b"):
        assert Q.measures(text) == base(text), text


def test_line_rules():
    bad = {"a | b | c | d": "navigation", "Home": "navigation", "All rights reserved.": "boilerplate",
           " ".join(["same"] * 30): "boilerplate", "A!! B!! C.": "punctuation", "a$$$ b### c***": "punctuation", "and so": "punctuation"}
    for line, why in bad.items():
        assert Q.line_failure(line) == why, line
    for line in ("", "  ", "Two words.", "A longer line that has no mark at its end", "He said: what?! No way. Yes.", "Fish & chips are good."):
        assert Q.line_failure(line) is None, line


def test_documents(spark):
    out = Q.line_first_cleaning(cases.documents(spark)).collect()
    want = [Q.judge(r[0], r[1]) for r in cases.texts() if r[0] != 306]
    assert cases.as_bag(r for r in out if r.doc_id != 306) == cases.as_bag(want)
    by = {r.doc_id: r for r in out}
    for i in (300, 301, 302):
        assert by[i].n_words == 0 and by[i].base_failed and not by[i].kept and by[i].lost_share == 0
    assert by[306].kept and by[306].n_words == 20_000


def test_keep_clean_keeps_columns(spark):
    docs = cases.documents(spark)
    kept = Q.keep_clean(docs)
    assert kept.schema == docs.schema
    want = [(r[0], Q.clean_text(r[1])[0]) for r in cases.texts() if Q.judge(r[0], r[1])[-2]]
    assert cases.as_bag(kept.select("doc_id", "text").collect()) == cases.as_bag(want)
    assert Q.keep_clean(docs.where("false")).count() == Q.line_first_cleaning(docs.where("false")).count() == 0


def test_clean_documents_stay_and_junk_goes(spark):
    sf = "/root/testdata/sf0.01"
    out = Q.op9_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    long = out.where("n_words >= 50")
    assert long.where("quality = 1 and not kept").count() == 0
    assert long.where("quality = 0 and kept").count() == 0
