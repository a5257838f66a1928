"""The methods of the training-data operators against brute force, their handling of odd tables, and held-out figures."""

import gzip
import io
import itertools
import json
import random
import zipfile
import zlib

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tablepact.llm import bytebpe, common, decontaminate, language, ordinal, quality, queries, tokens, toxicity, urls, warc

RANDOM = random.Random(11)
SF = "/root/testdata/sf0.01"
CLASH = "doc_id long, text string, id string, key string, row string, n_words long, score double, lang string, __text string"


def words(n, pool=400):
    return " ".join(f"w{RANDOM.randrange(pool)}" for _ in range(n))


# WARC


def http_record(kind, urn, body):
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + body if kind != "warcinfo" else body
    type_ = "application/http" if kind != "warcinfo" else "application/warc-fields"
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {urn}\r\nContent-Type: {type_}\r\nContent-Length: {len(http)}\r\n\r\n".encode() + http + b"\r\n\r\n"


@pytest.mark.parametrize("index", ["cdx", "cdxj", "cdxj.gz", None])
def test_archives_of_others(spark, tmp_path, index):
    """Several WARC members, packed and plain, under names of their own, with and without an index."""
    bodies = {f"<urn:{m}:{i}>": RANDOM.randbytes(RANDOM.randrange(1, 90_000)) for m in range(2) for i in range(12)}
    made = {f"rec-{m}.warc.gz": [http_record("response", f"<urn:{m}:{i}>", bodies[f"<urn:{m}:{i}>"]) for i in range(12)] for m in range(2)}
    made["plain.warc"] = [http_record("warcinfo", "<urn:p:0>", b"software: x"), http_record("response", "<urn:p:1>", b"body")]
    lines, files = [], {}
    for name, records in made.items():
        raw = b""
        for r in records:
            packed = gzip.compress(r) if name.endswith("gz") else r
            lines.append((name, len(raw), len(packed)))
            raw += packed
        files[f"archive/{name}"] = raw
    if index == "cdx":
        files["indexes/index.cdx"] = (" CDX N b a m s k r M S V g\n" + "".join(f"k 2024 u text/html 200 D - - {n} {at} {f}\n" for f, at, n in lines)).encode()
    elif index:
        raw = "".join("com,x)/ 2024 " + json.dumps({"filename": f, "offset": str(at), "length": str(n)}) + "\n" for f, at, n in lines).encode()
        files[f"indexes/index.{index}"] = gzip.compress(raw[:99]) + gzip.compress(raw[99:]) if index.endswith("gz") else raw
    with zipfile.ZipFile(tmp_path / "a.wacz", "w", zipfile.ZIP_STORED) as z:
        for name, raw in files.items():
            with z.open(name, "w", force_zip64=True) as f:
                f.write(raw)
        z.writestr(zipfile.ZipInfo("pages/pages.jsonl"), b"{}")
    got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/a.wacz",)], "path string")).collect()
    assert sorted((r.member, r.record_id) for r in got) == sorted((f"archive/{n}", f"<urn:{k}:{i}>") for n, k in (("rec-0.warc.gz", 0), ("rec-1.warc.gz", 1), ("plain.warc", "p")) for i in range(len(made[n])))
    by = {r.record_id: r for r in got}
    assert all(by[k].payload == v for k, v in bodies.items())
    assert by["<urn:p:1>"].payload == b"body" and by["<urn:p:0>"].record_type == "warcinfo"


@pytest.mark.parametrize("packed", [True, False])
def test_incomplete_indexes_are_completed(spark, tmp_path, packed):
    """An index names one record of five, or all but one; the comment of the archive looks like an end record."""
    records = [http_record("response", f"<urn:{i}>", RANDOM.randbytes(3000 + i)) for i in range(5)]
    parts = [gzip.compress(r) if packed else r for r in records]
    at = [sum(map(len, parts[:i])) for i in range(6)]
    for k, named in enumerate(([2], [0, 1, 3, 4], [])):
        lines = "".join("k 2024 " + json.dumps({"filename": "d.warc", "offset": at[i], "length": len(parts[i])}) + "\n" for i in named)
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", zipfile.ZIP_STORED) as z:
            z.writestr("archive/d.warc", b"".join(parts))
            z.writestr("indexes/index.cdxj", lines)
            z.comment = b"PK\5\6 is how an end record begins" + bytes(20)
        got = warc.read_archives(spark.createDataFrame([(f"file://{tmp_path}/{k}.zip",)], "path string")).collect()
        assert sorted(r.record_id for r in got) == [f"<urn:{i}>" for i in range(5)], named


def test_records_that_are_cut_off_are_refused():
    with pytest.raises(ValueError, match="cut off"):
        warc.parse_record(http_record("response", "<urn:1>", b"x" * 100)[:-40])


def test_packed_members_and_lost_names_are_refused(tmp_path):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("archive/a.warc.gz", b"x" * 100)
    raw = buffer.getvalue()
    with pytest.raises(ValueError):
        list(warc.record_places(warc.StoredZip(lambda at, n: raw[at : at + n], len(raw))))
    raw = b"".join(warc.zip_bytes([("indexes/i.cdxj", [b'k 2 {"filename": "gone", "offset": 0, "length": 1}'])]))
    with pytest.raises(ValueError):
        list(warc.record_places(warc.StoredZip(lambda at, n: raw[at : at + n], len(raw))))


# decontamination


def test_two_benchmarks_in_one_worker(spark):
    """Terms of an earlier search must not get into a later index, even where Python workers are used again."""
    small = spark.createDataFrame([(i, words(200)) for i in range(64)], "doc_id long, text string").repartition(2).cache()
    texts = {r.doc_id: r.text for r in small.collect()}
    for _ in range(3):
        some = RANDOM.choice(list(texts.values())).split()
        item = " ".join(some[50:64])
        items = spark.createDataFrame([(1, item)], "item_id long, text string")
        got = {r.doc_id: r.n_hit for r in decontaminate.contamination(small, items).collect()}
        grams = {tuple(item.split()[k : k + 10]) for k in range(5)}
        assert got == {i: len({k + x for k in range(191) if tuple(t.split()[k : k + 10]) in grams for x in range(10)}) for i, t in texts.items()}
        every = decontaminate.contamination(small, items, max_terms=3)
        assert {r.doc_id: r.n_hit for r in every.collect()} == got


def test_ids_keep_their_type_and_names_may_clash(spark):
    docs = spark.createDataFrame([("abc", "one two three", "x", "k", "r", 1, 0.5, "en", "t"), (None, "one two three", "x", "k", "r", 1, 0.5, "en", "t"), ("d", None, None, None, None, None, None, None, None), ("d", "four", "x", "k", "r", 1, 0.5, "en", "t")], CLASH.replace("doc_id long", "doc_id string"))
    items = spark.createDataFrame([(1, "two three")], "item_id long, text string")
    assert sorted(map(repr, ((r.doc_id, r.n_hit) for r in decontaminate.contamination(docs, items).collect()))) == sorted(map(repr, [("abc", 2), (None, 2), ("d", 0), ("d", 0)]))
    kept = decontaminate.clean_documents(spark, docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == ["d", "d"]


def test_very_long_texts(spark):
    """Whole texts are read: what counts lies behind a million characters."""
    long = words(180_000, 5000)
    assert len(long) > 10**6
    docs = spark.createDataFrame([(1, long + " tail alpha beta gamma delta epsilon zeta eta theta iota kappa"), (2, long)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta eta theta iota kappa")], "item_id long, text string")
    assert {r.doc_id: r.n_hit for r in decontaminate.contamination(docs, items).collect()} == {1: 10, 2: 0}
    t = Tokenizer.from_file(PATH := __import__("public_tokenizers").path(queries.VOCABULARY))
    assert [r.n_tokens for r in tokens.count_tokens(docs, PATH).orderBy("doc_id").collect()] == [len(t.encode(r.text).ids) for r in docs.orderBy("doc_id").collect()]
    led = quality.ledger(docs).orderBy("doc_id").collect()
    assert [r.n_words for r in led] == [180_011, 180_000]
    g = toxicity.Grammar(("blorp$",))
    assert g.outputs("he said " + "so " * 400_000 + "you blorp")[toxicity.OUTPUTS.index(toxicity.Symbol(toxicity.INSULT, 1, 0, 1))] == 1


# URL filters


def brute_branches(paths):
    """Kept nodes of one host by plain dictionaries: paths of names to (labelled, bad)."""
    nodes = {p[:k] for p in paths for k in range(len(p) + 1)}
    pool = {n: [0, 0] for n in nodes}
    for p, (n, b) in paths.items():
        pool[p] = [pool[p][0] + n, pool[p][1] + b]
    own = {n: tuple(v) for n, v in pool.items()}
    whole = {n: [sum(v[k] for p, v in paths.items() if p[: len(n)] == n) for k in (0, 1)] for n in nodes}
    kept = {}
    judged = lambda n: tuple(pool[n]) if pool[n][0] else tuple(whole[n])
    for level in range(max(map(len, nodes)), 0, -1):
        here = [n for n in nodes if len(n) == level]
        for parent in {n[:-1] for n in here}:
            children = [n for n in here if n[:-1] == parent]
            said = {n: judged(n) for n in children}
            total = [sum(x[k] for x in said.values()) + own[parent][k] for k in (0, 1)]
            for n in children:
                a, b = said[n]
                rest, rest_bad, p = total[0] - a, total[1] - b, total[1] / max(1, total[0])
                spread = (p * (1 - p) * (1 / max(1, a) + 1 / max(1, rest))) ** 0.5
                z = abs(b / max(1, a) - rest_bad / max(1, rest)) / max(spread, 1e-9)
                if rest > 0 and z >= urls.Z:
                    kept[n] = (a, b)
                else:
                    pool[parent][0] += pool[n][0]
                    pool[parent][1] += pool[n][1]
    kept[()] = judged(())
    return kept


def test_branches_equal_brute_force(spark):
    hosts, rows = {}, []
    for h in range(12):
        paths = {}
        for _ in range(RANDOM.randrange(3, 25)):
            p = tuple(RANDOM.choice("abc") for _ in range(RANDOM.randrange(0, 5)))
            n = RANDOM.randrange(1, 30)
            paths[p] = (n, RANDOM.choice([0, n, RANDOM.randrange(n + 1)]))
        hosts[f"h{h}"] = paths
        rows += [(f"h{h}", list(p), n, b) for p, (n, b) in paths.items()]
    got = urls.kept_branches(spark.createDataFrame(rows, "host string, names array<string>, labelled long, bad long")).collect()
    want = {(h, n): v for h, paths in hosts.items() for n, v in brute_branches(paths).items()}
    assert {(r.host, tuple(r.node)): (r.n, r.bad) for r in got} == want


def test_url_query_rows(spark):
    got = queries.op5_url_filters(spark, SF).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(pages)
    rule = lambda h, p: max(((len(str(r)), str(r), r.verdict) for r in urls.RULES if (h == r.host or h.endswith("." + r.host)) and p.startswith(r.path)), default=(0, None, None))[1:]
    for r in got:
        m = regex.match(r"(?s).*?://([^/?#]*)([^?#]*)", pages[r.page_id] or "")
        host, path = (m[1].lower(), m[2]) if m else ("", "")
        name, verdict = rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, name) and verdict in (None, r.verdict)


def test_url_templates_judge_held_out_pages(spark):
    """Pages that gave no label, by the language that their html names; hosts have good and bad templates."""
    sf = "/root/testdata/sf0.1"
    got = queries.op5_url_filters(spark, sf).collect()
    html = {r.page_id: regex.search(r'<html[^>]*\slang="(\w+)"', r.html or "") for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    free = [r for r in got if r.rule is None and html[r.page_id] and zlib.crc32(str(r.page_id).encode()) % 2]
    bad = {r.page_id for r in free if html[r.page_id][1] not in queries.WANTED}
    blocked = {r.page_id for r in free if r.verdict == "block"}
    by_host = {}
    for r in free:
        by_host.setdefault(r.host, set()).add(r.verdict)
    assert len(blocked & bad) >= 0.95 * len(blocked) and len(blocked & bad) >= 0.3 * len(bad) and sum(len(v) == 2 for v in by_host.values()) >= 5


def test_url_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.io/x", "h", "n", "t", "b"), (1, "http://a.io/x", "h", "n", "t", "b"), (None, "http://a.io/x", None, None, None, None), (2, None, "h", "n", "t", "b"), (3, "http://a.io/" + "y/" * 400, "h", "n", "t", "b")], "page_id long, url string, host string, names string, template string, bad string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "page_id long, bad int")
    got = urls.filter_urls(pages, labels).collect()
    assert len(got) == 5 and len([r for r in got if r.page_id == 1]) == 2
    assert urls.filter_urls(pages.limit(0), labels).count() == 0 and urls.filter_urls(pages, labels.limit(0)).where("verdict = 'block'").count() == 0


# language


def test_mixtures_equal_brute_force():
    """The chosen set has the best penalised likelihood of all sets of languages, each fitted until it stands still."""
    rng = np.random.default_rng(4)
    p = rng.dirichlet(np.full(300, 0.05), 4) + 1e-4
    p = (p / p.sum(axis=1, keepdims=True)).astype(np.float32)
    probability = np.full((4, language.BUCKETS), 1e-9, np.float32)
    grams = {w: language.trigrams(w) for w in ("".join(RANDOM.choice("abcdefgh") for _ in range(6)) for _ in range(300))}
    for (w, g), column in zip(grams.items(), p.T):
        probability[:, g] += column[:, None]
    probability /= probability.sum(axis=1, keepdims=True)
    model, vocabulary = language.LanguageModel(tuple("abcd"), probability, np.full(4, 0.25, np.float32)), list(grams)
    for _ in range(25):
        some = RANDOM.sample(range(4), RANDOM.choice([1, 1, 2, 3]))
        text = " ".join(vocabulary[min(299, int(np.searchsorted(np.cumsum(p[at]), rng.random())))] for at in some for _ in range(RANDOM.randrange(60, 200)))
        seen, counts = np.unique(language.trigrams(text), return_counts=True)
        n, best = counts.sum(), None
        for k in range(1, 5):
            for chosen in itertools.combinations(range(4), k):
                q, share = probability[list(chosen)][:, seen].astype(float), np.full(k, 1 / k)
                for _ in range(400):
                    share = share * (q @ (counts / (share @ q))) / n
                value = float(np.log(share @ q) @ counts) * language.EVIDENCE - (k - 1) * (0.5 * np.log(n + 1) + 1)
                if best is None or value > best[0]:
                    best = value, set(chosen), dict(zip(chosen, share))
        found, proportions = model.mixture(text)
        assert set(found.tolist()) == best[1]
        assert all(abs(s - best[2][i]) < 0.03 for i, s in zip(found.tolist(), proportions.tolist()))


# toxicity


def test_composed_grammar_equals_the_machines_one_after_another():
    kinds = [toxicity.Symbol(k) for k in range(7)]
    for _ in range(1500):
        clause = [(RANDOM.choice(kinds), 1.0) for _ in range(RANDOM.randrange(0, 9))]
        paths = [clause]
        for m in toxicity.MACHINES:
            paths = [out for p in paths for out in m.outputs(p)]
        composed = toxicity.GRAMMAR.outputs(clause)
        assert len(paths) == len(composed) == 1 and [s for s, _ in paths[0]] == [s for s, _ in composed[0]] and np.allclose([w for _, w in paths[0]], [w for _, w in composed[0]])
        matches = [(s, w) for s, w in composed[0] if s.match]
        tabled = toxicity.TABLES.matches([s.kind for s, _ in clause])
        assert [toxicity.OUTPUTS[i] for i in tabled] == [s for s, _ in matches] and np.allclose(toxicity.TABLES.weight[tabled], [w for _, w in matches])


def test_rare_insults_are_learned(spark):
    rude = ["blorp"] * 120 + ["snerk"] * 6 + ["gramf"] * 5
    rows = [(1, f"{words(30, 900)} {w} {words(20, 900)}") for w in rude] + [(0, words(60, 900)) for _ in range(800)]
    df = spark.createDataFrame([(t, toxicity.stems(x)) for t, x in rows], "toxic int, stems array<string>")
    found = toxicity.learn_insults(df)
    assert all(any(f.removesuffix("$") in w or w in f for f in found) for w in ("blor", "sner", "gram")) and len(found) <= 5


def test_held_out_figures(spark):
    """Accuracy on documents that weren't learned from, of the registered queries."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    toxic = queries.op10_toxicity(spark, SF).where("held_out").join(labels, "doc_id").collect()
    right = [(r.predicted == 1) == (r.toxic == 1) for r in toxic]
    assert len(right) > 30 and np.mean(right) >= 0.9
    good = queries.op8_quality_classifier(spark, SF).where("held_out").join(labels, "doc_id").collect()
    assert np.mean([r.kept == (r.quality == 1) for r in good]) >= 0.9
    lang = queries.op6_language_id(spark, SF).where("held_out and lang_pred <> 'und'").join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("lang is not null").collect()
    assert np.mean([r.lang_pred == r.lang for r in lang]) >= 0.97


# odd tables, settings


def test_empty_and_clashing_tables(spark):
    df = spark.createDataFrame([(1, "you are fine", "i", "k", "r", 1, 0.5, "en", "t"), (1, "you are fine", "i", "k", "r", 1, 0.5, "en", "t"), (None, None, None, None, None, None, None, None, None)], CLASH)
    empty, labels = df.limit(0), spark.createDataFrame([(1, 1, 1)], "doc_id long, toxic int, quality int")
    for docs in (df, empty):
        model = toxicity.train(docs, labels)
        assert toxicity.score_documents(docs, model).count() == docs.count()
        grades = ordinal.train(docs, labels.select("doc_id", F.col("quality").alias("grade")), rounds=2)
        assert ordinal.grade_documents(docs, grades, 1.0, keep=("row", "key")).count() == docs.count()
        assert ordinal.select_documents(docs, grades, 1.0).columns == docs.columns
        learned = language.learn(docs)
        assert language.identify(docs, learned, keep=("id",)).count() == docs.count()
        assert quality.filter_documents(docs).columns == docs.columns
    pages = df.selectExpr("doc_id AS page_id", "text AS url", "text AS html", "id AS hex", "key AS first", "row AS payload")
    assert warc.round_trip(spark, pages).count() == 3 and warc.round_trip(spark, pages.limit(0)).count() == 0
    with pytest.raises(ValueError):
        tokens.count_tokens(df.withColumn("n_tokens", F.lit(1)), __import__("public_tokenizers").path(queries.VOCABULARY), keep=("n_tokens",))


def test_session_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    for name in ("op1_warc", "op3_token_counts", "op6_language_id"):
        queries.queries()[name](spark, "/root/testdata/sf0.001").count()
    assert spark.conf.get(key) == before


def test_a_cluster_needs_a_shared_folder():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "local-cluster[3,2,1000]"

    with pytest.raises(ValueError):
        common.scratch_root(Cluster)


def test_newer_letters_follow_the_library():
    """``NEWER`` is what the regex module takes for a letter or number and the library, by its splits, doesn't."""
    t = Tokenizer.from_file(__import__("public_tokenizers").path(queries.VOCABULARY))
    split = t.pre_tokenizer.pre_tokenize_str
    listed = {c for a, b in bytebpe.NEWER for c in range(a, b + 1)}
    some = [c for c in range(0x20, 0x32000) if not 0xD800 <= c < 0xE000 and regex.match(r"[\p{L}\p{N}]", chr(c))]
    odd = {c for c in some if len(split("a" + chr(c))) == 2 and regex.match(r"\p{L}", chr(c)) or len(split("1" + chr(c))) == 2 and regex.match(r"\p{N}", chr(c))}
    assert odd == listed & set(some)
