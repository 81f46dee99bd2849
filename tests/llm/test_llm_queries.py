"""The registered queries over the driver's small tables."""

import base64
import hashlib
import os
import re
import zlib
from collections import Counter

import pytest

from tests.compare import assert_same, connect
from tests.llm.test_llm_decontaminate import brute
from tests.llm.test_llm_secrets import brute as base_spans
from tests.llm.test_llm_simhash import brute_print
from tramline.llm import queries, secrets
from tramline.store import stage

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="needs the driver's tables")


@pytest.fixture(scope="module")
def db():
    return connect(D)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_matches_sql(spark, db, name):
    assert_same(queries.QUERIES[name](spark, D).toPandas(), db.execute(queries.ORACLES[name]).df())


def test_names_and_columns(spark):
    assert [n.split("_")[0] for n in queries.QUERIES if n.startswith("op")] == [f"op{i}" for i in range(1, 11)]
    assert queries.op2_quality_rules(spark, D).columns[:8] == ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    assert queries.op3_kd_shards(spark, D).dtypes == [("doc_id", "bigint"), ("size", "bigint"), ("text_crc32", "bigint"), ("law", "string"), ("shard", "int"), ("slot", "bigint"), ("grown_shard", "int")]


def test_bpe_and_rollup(spark, db):
    import public_tokenizers as p
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(p.path(queries.RANKS), "rb"))}
    enc = tiktoken.Encoding("own", pat_str=p.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = db.execute("SELECT doc_id, text, source, lang FROM documents").fetchall()
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op1_byte_bpe(spark, D).collect()}
    sums, seen = {}, set()
    for i, text, source, lang in sorted(docs):
        ids = enc.encode_ordinary(text or "")
        assert got[i] == (len(ids), hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())
        if text not in seen:
            seen.add(text)
            for version, n in ((queries.RANKS, len(ids)), ("words", len((text or "").encode().split()))):
                a, b = sums.get((source, lang, version), (0, 0))
                sums[source, lang, version] = (a + 1, b + n)
    assert {(r.source, r.lang, r.tokenizer_version): (r.n_docs, r.n_tokens) for r in queries.op4_token_rollup(spark, D).collect()} == sums


def test_secrets_and_fingerprints(spark, db):
    docs = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    for r in queries.op7_secret_ledger(spark, D).collect():
        found = secrets.find(docs[r.doc_id] or "")
        counts, base = base_spans(docs[r.doc_id])
        assert [r.n_assign, r.n_access, r.n_hex] == counts and r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans == secrets.joined(found)
    prints = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in queries.op9_simhash(spark, D).collect()}
    assert {i: p for i, (p, _) in prints.items()} == {i: brute_print(t) for i, t in docs.items()}
    for i, (p, c) in prints.items():
        for j, (q, e) in prints.items():
            if (p ^ q).bit_count() <= 2:
                assert c == e and c <= min(i, j)


def test_quality_columns_and_verdict(spark, db):
    docs, labels = (dict(db.execute(f"SELECT doc_id, {c} FROM {t}").fetchall()) for c, t in (("text", "documents"), ("quality", "labels")))
    agree = []
    for r in queries.op2_quality_rules(spark, D).collect():
        text = docs[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
        repeated = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(repeated))
        assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words)) and not (r.base_failed and r.kept)
        if labels.get(r.doc_id) is not None and not r.base_failed:
            agree.append(r.kept == bool(labels[r.doc_id]))
    assert sum(agree) >= 0.95 * len(agree)


def test_shards_hold_whole_groups(spark, db):
    docs = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    each, slots, places, weight = Counter(), {}, {}, Counter()
    for r in queries.op3_kd_shards(spark, D).collect():
        raw = (docs[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "bytes") and 0 <= r.shard < 40
        each[r.shard] += r["size"]
        weight[raw] += r["size"]
        slots.setdefault(r.shard, []).append(r.slot)
        places.setdefault(raw, set()).add(r.shard)
    assert sum(map(len, slots.values())) == len(docs) and all(sorted(v) == list(range(len(v))) for v in slots.values())
    mean = sum(each.values()) / 40
    assert all(len(p) == 1 or weight[t] > mean for t, p in places.items())
    # A document may be as large as a shard here, so evenness is up to the largest.
    assert max(each.values()) <= mean + max(len((t or "").encode()) for t in docs.values())


def test_leaks(spark, db):
    exact = set(db.execute("SELECT doc_id, item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)").fetchall())
    got = {(r.doc_id, r.item_id) for r in queries.op10_latent_decontamination(spark, D).collect()}
    assert exact <= got
    # All pairs of documents and items, by the checks alone.
    docs, items = (db.execute(f"SELECT {k}, coalesce(text, '') FROM {t} ORDER BY {k}").fetchall() for k, t in (("doc_id", "documents"), ("item_id", "benchmark")))
    assert got == {(k, items[i][0]) for k, i in brute(docs, [t for _, t in items])}


def test_pipeline(spark, db):
    import corpus_pipeline as pipeline

    docs = dict(db.execute("SELECT doc_id, text FROM documents").fetchall())
    frames, df = {}, spark.read.parquet(f"{D}/documents.parquet")
    for name, function in pipeline.STAGES:
        df = stage(function(spark, df, D), "test-stage")
        frames[name] = df
    names = [n for n, _ in pipeline.STAGES]
    for n in names[:-1]:
        assert frames[n].columns == pipeline.COLUMNS
    good = {r.doc_id for r in frames[names[0]].collect()}
    assert all(len(docs[i].encode().split()) >= 50 for i in good)
    # One of each component of what the first stage kept, linked by sets of five-word shingles, and that of the smallest id.
    sets = {}
    for i in good:
        words = docs[i].encode().lower().split()
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}
    group = {i: i for i in good}
    changed = True
    while changed:
        changed = False
        for i in good:
            for j in good:
                if group[j] > group[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    group[j], changed = group[i], True
    single = {r.doc_id for r in frames[names[1]].collect()}
    assert single == {i for i in good if group[i] == i}
    bench = [t for (t,) in db.execute("SELECT text FROM benchmark").fetchall()]
    clean = {r.doc_id for r in frames[names[2]].collect()}
    assert clean <= single and not any(t in docs[i] for i in clean for t in bench)
    assert {i for i in single - clean} == {i for i in single if any(t in docs[i] for t in bench)}
    rows = {r.doc_id: r for r in frames[names[3]].collect()}
    assert set(rows) == clean
    for i, r in rows.items():
        assert r.text == secrets.redact(docs[i], secrets.find(docs[i])) and not secrets.find(r.text.replace("[REDACTED]", " "))
    last = {r.doc_id: r for r in frames[names[4]].collect()}
    assert set(last) == clean and all(r.decoded_sha256 == hashlib.sha256(rows[i].text.encode()).hexdigest() for i, r in last.items())
    assert pipeline.run(spark, D).count() == len(last)


def test_pipeline_with_odd_rows(spark, tmp_path):
    import corpus_pipeline as pipeline

    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, good, "en", "s", 9, "x"), (1, good, "en", "s", 9, "x"), (None, good + " more", None, None, None, "x"), (2, None, None, None, None, "x"), (3, "", "en", "s", 0, "x"), (4, good[::-1] + " token=abcdefgh", "en", "s", 5, "x")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, hash string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert sorted(r.doc_id or 0 for r in pipeline.run(spark, str(tmp_path)).collect()) in ([0, 4], [0, 1, 4])
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/none/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{tmp_path}/{t}.parquet").write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert pipeline.run(spark, f"{tmp_path}/none").count() == 0
