"""The training-data operators against brute force, round trips and held-out accuracy, with nulls, empties, ties and clashes."""

import base64
import hashlib
import random
import re
import struct

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablepact.llm import decontaminate, language, ordinal, quality, queries, similarity, tokens, toxicity, urls, warc

VOCAB = public_tokenizers.path(queries.VOCABULARY)
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns whose names the operators use inside.
CLASH = "doc_id long, text string, id string, n long, n_words long, __text string, lang_pred string, value string"
RANDOM = random.Random(5)


def words(n, pool=400):
    return " ".join(f"w{RANDOM.randrange(pool)}" for _ in range(n))


ODD = [None, "", "   \n\t ", "a", "x" * 30_000, "Ünïcödé 你好 🎉", "<|endoftext|> in text", "ananananan banananananana", "line\nline\n\nline", " ".join(["same"] * 500), "՘ ࢏ Ᲊ   \x1c 　"]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "x", i, i, "y", "z", "v") for i, t in enumerate(ODD)] + [(None, "null id", None, None, None, None, None, None), (3, "a", "x", 1, 1, "y", "z", "v")]
    return spark.createDataFrame(rows, CLASH)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_tokens_equal_the_library(spark, odd, empty):
    t = Tokenizer.from_file(VOCAB)
    counted = tokens.count_tokens(odd, VOCAB).collect()
    texts = [*ODD, "null id", "a"]
    assert [r.n_tokens for r in counted] == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    encoded = tokens.encode(odd, VOCAB, columns=tuple(tokens.ENCODED)).collect()
    assert [r.ids for r in encoded] == [t.encode(x or "", add_special_tokens=False).ids for x in texts]
    assert [r.decoded for r in encoded] == [x or "" for x in texts]
    back = tokens.decode(tokens.encode(odd.where("doc_id = 5"), VOCAB), VOCAB).first()
    assert back.text == ODD[5]
    assert tokens.count_tokens(empty, VOCAB).count() == tokens.encode(empty, VOCAB).count() == 0


def test_random_strings_encode_like_the_library(spark):
    t = Tokenizer.from_file(VOCAB)
    texts = ["".join(RANDOM.choice("aann  th'sre\n1é😀.") for _ in range(RANDOM.randrange(1, 120))) for _ in range(300)]
    got = tokens.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), VOCAB).orderBy("doc_id").collect()
    assert [r.ids for r in got] == [t.encode(x, add_special_tokens=False).ids for x in texts]


def brute_quality(text):
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
    ls = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(ws[i : i + 8]) for i in range(len(ws) - 7)]
    hit = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(8)}
    return len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text or "")), len(ls) - len(set(ls)), len(hit)


def test_quality_ledger(spark, odd, empty):
    got = quality.ledger(odd, keep=("value",)).collect()
    assert [(r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got] == [brute_quality(x) for x in [*ODD, "null id", "a"]]
    texts = [words(40), words(12) + " " + words(9, 3) * 4, " ".join("#a" for _ in range(30)), "UP " * 25]
    led = quality.ledger(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert [r.n_repeat_words for r in led.collect()] == [brute_quality(x)[4] for x in texts]
    assert [r.kept for r in quality.apply_policy(led, quality.PROSE).collect()] == [True, False, False, False]
    rows = {r.rule: r for r in quality.ablation(led, quality.PROSE).collect()}
    assert rows["symbols"].n_docs == 4 and rows["repeated_windows"].n_failed == 3 and rows["few_words"].n_failed == 0
    assert quality.ledger(empty).count() == 0 and quality.filter_documents(empty).columns == empty.columns


def test_warc_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/", None), (4, "http://c/", ""), (5, "u", "é" * 70_000), (5, "u", "é" * 70_000), (None, "n", "x")], "page_id long, url string, html string")
    for zip64 in (False, True):
        got = warc.round_trip(spark, pages, with_payload=True, zip64=zip64, roll_bytes=100).collect()
        by = {}
        for r in got:
            by.setdefault(r.record_id, []).append(r)
        assert len(got) == 7 and by["<urn:page:1>"][0].record_type == "revisit" and by["<urn:page:1>"][0].refers_to == "<urn:page:2>"
        assert by["<urn:page:2>"][0].payload == b"x" and by["<urn:page:2>"][0].target_uri is None and by["<urn:page:3>"][0].refers_to == "<urn:page:4>"
        assert [r.record_type for r in by["<urn:page:5>"]] == ["response"] * 2 and by["<urn:page:5>"][0].payload_bytes == 140_000
        assert by["<urn:page:1>"][0].payload_digest == base64.b32encode(hashlib.sha1(b"x").digest()).decode()
        assert by[None][0].record_type == "response"
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_zip_is_read_by_others_and_damage_is_refused(tmp_path):
    import zipfile

    raw = b"".join(warc.zip_bytes([("a", [b"12", b"3"]), ("b/c", [b""])], zip64=True))
    (tmp_path / "z.zip").write_bytes(raw)
    with zipfile.ZipFile(tmp_path / "z.zip") as z:
        assert z.read("a") == b"123" and z.testzip() is None
    ours = warc.StoredZip(lambda at, n: raw[at : at + n], len(raw))
    at, n = ours.locate("a")
    assert raw[at : at + n] == b"123"
    with pytest.raises(ValueError):
        warc.StoredZip(lambda at, n: raw[at : at + n], len(raw) - 30)
    with pytest.raises((ValueError, struct.error)):
        warc.parse_record(b"junk\r\n\r\n")


def test_decontamination(spark, odd, empty):
    phrase = "the quick brown fox jumps over the lazy dog again and again"
    docs = spark.createDataFrame([(1, f"xx {phrase.upper()}! {phrase}"), (2, "the quick brown fox jumps over the lazy cat"), (3, None), (4, "tiny one"), (5, "a tiny  ONE, b"), (5, "a tiny  ONE, b")], "doc_id long, text string")
    items = spark.createDataFrame([(7, phrase), (8, "tiny one"), (9, None), (10, "--"), (7, phrase)], "item_id long, text string")
    for block in (100, 2):
        got = sorted((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in decontaminate.contamination(docs, items, block=block).collect())
        assert got == [(1, 25, 24, ("7",)), (2, 9, 0, ()), (3, 0, 0, ()), (4, 2, 2, ("8",)), (5, 4, 2, ("8",)), (5, 4, 2, ("8",))]
    index = decontaminate.build_index(docs)
    assert {(r.doc_id, r.position) for r in decontaminate.proximity(index, ["lazy", "fox"], 5).collect()} == {(1, 4), (1, 16), (2, 3)} and not decontaminate.proximity(index, ["fox", "tiny"], 9).count()
    kept = decontaminate.clean_documents(spark, docs, items)
    assert sorted(r.doc_id for r in kept.collect()) == [2, 3] and decontaminate.clean_documents(spark, empty, items).count() == 0
    assert decontaminate.contamination(odd, items).count() == len(ODD) + 2


def test_urls(spark):
    rows = [(1, "http://WWW.A.net/x?q"), (2, "https://example.net/en/1#f"), (3, "https://de.example.com/de/"), (4, "http://b.org/fr/2"), (5, None), (6, "nothing"), (7, "http://c.io"), (8, "http://notnet/x")]
    rows += [(100 + i, f"http://mixed.io/bad/{i}") for i in range(40)] + [(200 + i, f"http://mixed.io/good/{i}") for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string")
    labels = spark.createDataFrame([(i, 1) for i in range(100, 120)] + [(i, 0) for i in range(200, 220)], "page_id long, bad int")
    got = {r.page_id: r for r in urls.filter_urls(pages, labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule, got[i].verdict) for i in range(1, 9)] == [
        ("www.a.net", "/x", "net/", "block"), ("example.net", "/en/1", "example.net/en/", "allow"), ("de.example.com", "/de/", "example.com/de/", "block"), ("b.org", "/fr/2", "org/fr/", "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("c.io", "", None, "allow"), ("notnet", "/x", None, "allow"),
    ]
    assert got[139].verdict == "block" and got[239].verdict == "allow" and got[139].template == "/bad/<n>"
    assert urls.filter_urls(pages.limit(0), labels).count() == 0


def test_url_branches(spark):
    rows = [(i, f"http://h.io/news/{i}", 0) for i in range(1000)] + [(2000 + i, f"http://h.io/spam/{c}/{i}", 1) for i, c in enumerate("abcdefghijklmno")] + [(3000, "http://h.io/spam/other/1", None), (3001, "http://h.io/news/x/y", None)]
    for i in range(20):  # below the fourth level
        rows += [(4000 + i, f"http://deep.io/a/b/c/d/e/bad/{i}", 1), (5000 + i, f"http://deep.io/a/b/c/d/e/good/{i}", 0)]
    # a good section doesn't hide the others of its branch
    rows += [(6000 + i, f"http://k.io/spam/{c}/{i}", 1) for i, c in enumerate("abcdefghijklmno")] + [(7000 + i, f"http://k.io/spam/fine/{i}", 0) for i in range(40)] + [(8000 + i, f"http://k.io/news/{i}", 0) for i in range(1000)]
    rows += [(9000, "http://deep.io/a/b/c/d/e/bad/1", None), (9001, "http://deep.io/a/b/c/d/e/good/1", None), (9002, "http://k.io/spam/other/1", None), (9003, "http://k.io/spam/fine/99", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, bad int")
    got = {r.page_id: r for r in urls.filter_urls(df.select("page_id", "url"), df.where("bad is not null").select("page_id", "bad")).collect()}
    assert len(got) == len(rows) and got[3000].template == "/spam/other/<n>" and got[9000].template == "/a/b/c/d/e/bad/<n>"
    assert abs(got[3000].purity - 0.66) < 0.01
    blocked = {i for i, r in got.items() if r.verdict == "block"}
    assert blocked == {i for i, _, bad in rows if bad} | {3000, 9000, 9002}


def test_language(spark, odd, empty):
    rows = [(i, " ".join(RANDOM.choice(pool) for _ in range(60)), lang) for i in range(60) for lang, pool in [("aa", ["kolo", "tama", "baro"]), ("bb", ["schwer", "ächt", "grün"])]]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    docs = spark.createDataFrame([(1, "kolo tama baro kolo baro"), (2, "schwer grün ächt"), (3, "kolo tama baro " * 30 + "schwer grün ächt " * 30), (4, "123 !!"), (5, None)], "doc_id long, text string")
    got = language.identify(docs, model).collect()
    assert [r.lang_pred for r in got[:2]] == ["aa", "bb"] and set(got[2].languages) == {"aa", "bb"} and [r.lang_pred for r in got[3:]] == ["und", "und"]
    assert all(0 <= r.score <= 1 for r in language.identify(odd, model).collect())
    nothing = language.learn(empty)
    assert [r.lang_pred for r in language.identify(docs, nothing).collect()] == ["und"] * 5


def test_ordinal_grades(spark, odd):
    pools = [["bad", "junk"], ["plain", "okay"], ["good", "fine"], ["best", "great"]]
    rows = [(i, " ".join(RANDOM.choice(pools[min(3, max(0, i % 4 + RANDOM.choice([0, 0, 0, 1, -1])))] + ["the", "of"]) for _ in range(40)), float(i % 4)) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, grade double")
    model = ordinal.train(df.where("doc_id < 300").select("doc_id", "text"), df.select("doc_id", "grade"), rounds=30)
    assert model.grades == (0.0, 1.0, 2.0, 3.0) and (np.diff(model.thresholds) >= 0).all()
    got = ordinal.grade_documents(df.where("doc_id >= 300"), model, 2.0, keep=("grade",)).collect()
    assert np.corrcoef([r.grade for r in got], [r.expected_grade for r in got])[0, 1] > 0.7
    assert all(0 <= r.tail_probability <= 1 for r in ordinal.grade_documents(odd, model, 2.0).collect())
    one = ordinal.train(df, df.select("doc_id", F.lit(1.0).alias("grade")), rounds=2)
    assert all(r.tail_probability == 1 for r in ordinal.grade_documents(df, one, 1.0).collect())


def test_toxicity(spark, odd):
    plain = [f"they met the {words(6)}. it was {words(5)}" for _ in range(120)]
    rude = [f"{words(5)}, you are a {RANDOM.choice(['blorp', 'snerk'])} and a blorp. {words(6)}" for _ in range(60)]
    rows = [(i, t, int(i >= 120)) for i, t in enumerate(plain + rude)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.train(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert any(w.startswith("blor") for w in model.insults)
    docs = spark.createDataFrame([(1, "you blorp, you snerk blorp"), (2, "kind words"), (3, None), (4, "he said: you are not a blorp")], "doc_id long, text string")
    s = {r.doc_id: r.score for r in toxicity.score_documents(docs, model).collect()}
    assert s[1] >= 0.5 > s[2] == s[3] and s[4] < s[1]
    assert toxicity.score_documents(odd, model).count() == len(ODD) + 2


def test_grammar_states():
    g = toxicity.Grammar(("blorp$", "sner"))
    hit = lambda t: [(o.target, o.negated, o.reported) for o in (toxicity.OUTPUTS[i] for i in np.flatnonzero(g.outputs(t)[:-1]))]
    assert hit("you blorp") == hit("blorp, you") == [(1, 0, 0)] and hit("not a blorp") == [(0, 1, 0)] and hit("he said a blorp")[0][2] == 1
    assert hit("blorpish") == [] and hit("snerkish") == [(0, 0, 0)] and hit(None) == []


SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_has_its_sql_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert sorted(map(repr, map(tuple, got.select(*cols).collect()))) == sorted(map(repr, con.execute(f"SELECT {', '.join(cols)} FROM ({queries.oracle_sql()[name]})").fetchall()))


def test_pipeline_stages(spark, empty):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        out = stage(spark, docs, SF).cache()
        assert out.columns == list(p.COLUMNS) and out.count() <= docs.count() and out.join(docs, "doc_id", "left_anti").count() == 0
        assert stage(spark, empty, SF).count() == 0
        docs = out
    t = Tokenizer.from_file(VOCAB)
    for r in p.encoding(spark, docs, SF).join(docs, "doc_id").limit(20).collect():
        assert r.ids == t.encode(r.text, add_special_tokens=False).ids


def test_inner_names_give_way(spark):
    import public_tokenizers

    from tablepact.llm import language, tokens

    docs = spark.createDataFrame([(1, "the text", "kept"), (2, None, "kept")], "doc_id long, text string, __text string")
    counted = tokens.count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), keep=("__text",)).orderBy("doc_id").collect()
    assert [(r["__text"], r.n_tokens) for r in counted] == [("kept", 2), ("kept", 0)]
    model = language.learn(spark.createDataFrame([(1, "the house and", "en"), (2, "das Haus und", "de")], "doc_id long, text string, lang string"))
    assert [r["__text"] for r in language.identify(docs, model, keep=("__text",)).collect()] == ["kept", "kept"]
