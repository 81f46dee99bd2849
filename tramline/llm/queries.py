"""The registered queries of the training-data operators; each derives its digest from its operator's output."""

from __future__ import annotations

import functools

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.llm import bpe, chat, decontaminate, quality, repeats, rollup, secrets, sharding, simhash, warc
from tramline.llm.common import WORD, documents
from tramline.store import scratch, stage

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of documents."""
    ids = bpe.encode(documents(spark, sf_dir), ["doc_id"], RANKS, public_tokenizers.PATTERN)
    raw = bpe.decode(ids, ["doc_id", "n_tokens", "token_ids"], RANKS, public_tokenizers.PATTERN)
    return raw.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and verdict of every text of documents; the classifier is fitted on labels."""
    found = quality.quality(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), "doc_id")
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op3_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in 40 shards of nearly equal bytes."""
    placed = sharding.kd_shards(documents(spark, sf_dir), "doc_id")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches over documents: inserts by an estimate, its revision to the true word counts, inserts
    of a second tokenizer's counts, and deletes of every copy but the one of the smallest id. The first batch is then
    committed once more, which changes nothing."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source", "lang")
    encoded = bpe.encode(docs, ["doc_id", "source", "lang", "text"], RANKS, public_tokenizers.PATTERN)
    words = F.size(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(f"({WORD})"), F.lit(1)))
    counts = encoded.select(
        "doc_id", "source", "lang", F.sha1(F.coalesce("text", F.lit("")).cast("binary")).alias("blob"),
        F.floor(F.coalesce(F.length("text"), F.lit(0)) / 6).alias("estimate"), words.alias("words"), F.col("n_tokens").alias("tokens"),
    )
    counts = stage(counts, "token-counts")
    # Deleting the copies is deleting all and putting the first of each text back; no join meets a group of copies.
    order = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "source", "lang", "words", "tokens")
    first = counts.groupBy("blob").agg(F.min(order).alias("first")).select("first.*")
    copies = []
    for version, tokens in (("words", "words"), (RANKS, "tokens")):
        copies += [rollup.deletes(counts, version, tokens), rollup.inserts(first, version, tokens)]
    totals = rollup.TokenRollup(spark, scratch(spark, "token-rollup"))
    totals.commit("words", rollup.inserts(counts, "words", "estimate"))
    totals.commit("words-revised", rollup.revisions(counts, "words", "estimate", "words"))
    totals.commit("bpe", rollup.inserts(counts, RANKS, "tokens"))
    totals.commit("copies", functools.reduce(DataFrame.unionByName, copies))
    totals.commit("words", rollup.inserts(counts, "words", "estimate"))
    return totals.totals()


def op5_preference_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) as preference pairs."""
    turns = documents(spark, sf_dir, "conversations").select(
        F.floor(F.col("conv_id") / 2).alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 1).alias("is_rejected"), "turn", "role", "text"
    )
    pairs = chat.preference_pairs(turns, "pair_id", "is_rejected")

    def joined(mask: str):
        return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["end"])), ",").alias(mask)

    return pairs.select("pair_id", "n_prefix", "prompt", "chosen", "rejected", joined("chosen_mask"), joined("rejected_mask"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write pages as WARC archives and read them back."""
    path = scratch(spark, "warc")
    warc.write(documents(spark, sf_dir, "pages"), path, "page_id")
    found = warc.read(spark, path)
    return found.where(F.col("gap").isNull()).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def warc_salvage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as WARC archives in which the member of every page divisible by 7 is then damaged: the pages that are
    read back, and a last row without a page, whether the bytes quarantined are just those of the damaged members."""
    path = scratch(spark, "warc")
    warc.write(documents(spark, sf_dir, "pages"), path, "page_id")
    found = warc.read_contents(warc.damaged(warc.archives(spark, path), 7))
    kept = found.where(F.col("gap").isNull()).select("page_id", F.col("payload_digest").alias("digest"), F.lit(True).alias("kept"))
    lost = warc.read(spark, path).where(F.col("page_id") % 7 == 0).agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("bytes"))
    gaps = found.where(F.col("gap").isNotNull()).agg(F.sum("length").alias("quarantined"))
    total = lost.join(gaps).select(F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("digest"), (F.col("bytes") == F.col("quarantined")).alias("kept"))  # one row
    return kept.unionByName(total)


def op7_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan every text of documents through a new ledger."""
    found = secrets.scan(documents(spark, sf_dir), scratch(spark, "secret-ledger"), ["doc_id"])
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans")


def op8_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Remove from every text of documents what repeats over 35 words."""
    found = repeats.remove_repeats(documents(spark, sf_dir), "doc_id")
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every text of documents."""
    found = simhash.near_duplicates(documents(spark, sf_dir), "doc_id")
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of benchmark found in documents."""
    found = decontaminate.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"), "doc_id")
    return found.select("doc_id", "item_id", "lcs", "item_words", *[F.round(c, 3).alias(c) for c in ("cosine", "share", "answer")], "start", "end")


QUERIES = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_kd_shards": op3_kd_shards,
    "op4_token_rollup": op4_token_rollup,
    "op5_preference_chat": op5_preference_chat,
    "op6_warc": op6_warc,
    "op7_secret_ledger": op7_secret_ledger,
    "op8_repeats": op8_repeats,
    "op9_simhash": op9_simhash,
    "op10_latent_decontamination": op10_latent_decontamination,
    "warc_salvage": warc_salvage,
}
_SIDE = """string_agg('<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10), '' ORDER BY k)"""

ORACLES: dict[str, str] = {
    "op5_preference_chat": f"""WITH c AS (SELECT conv_id // 2 AS pair_id, conv_id % 2 = 1 AS rej, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
  row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS k FROM conversations),
p AS (SELECT pair_id FROM c GROUP BY ALL HAVING bool_or(rej) AND bool_or(NOT rej)),
m AS (SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.k, b.k) AS k, coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM c WHERE NOT rej) a FULL JOIN (SELECT * FROM c WHERE rej) b ON a.pair_id = b.pair_id AND a.k = b.k),
n AS (SELECT pair_id, CAST(coalesce(min(k) FILTER (NOT same) - 1, max(k)) AS INTEGER) AS n FROM m GROUP BY ALL),
r AS (SELECT c.*, n, length('<|' || role || '|>' || chr(10)) AS head, length(text) + 8 AS body FROM c JOIN p USING (pair_id) JOIN n USING (pair_id)),
o AS (SELECT *, sum(CASE WHEN k > n THEN head + body ELSE 0 END) OVER (PARTITION BY pair_id, rej ORDER BY k) - body AS s FROM r)
SELECT pair_id, n AS n_prefix, coalesce({_SIDE.replace("ORDER BY k)", "ORDER BY k) FILTER (NOT rej AND k <= n)")}, '') AS prompt,
  coalesce({_SIDE.replace("ORDER BY k)", "ORDER BY k) FILTER (NOT rej AND k > n)")}, '') AS chosen, coalesce({_SIDE.replace("ORDER BY k)", "ORDER BY k) FILTER (rej AND k > n)")}, '') AS rejected,
  coalesce(string_agg(s || ':' || (s + body), ',' ORDER BY k) FILTER (NOT rej AND k > n AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(s || ':' || (s + body), ',' ORDER BY k) FILTER (rej AND k > n AND role = 'assistant'), '') AS rejected_mask FROM o GROUP BY pair_id, n""",
    "op6_warc": """WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS b, sha1(coalesce(html, '')) AS h FROM pages), g AS (SELECT h, max(page_id) AS first FROM p WHERE b >= 1000 GROUP BY h)
SELECT page_id, b AS payload_bytes, p.h AS payload_digest, CASE WHEN b >= 1000 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN b >= 1000 AND page_id <> first THEN first END AS refers_to FROM p LEFT JOIN g ON g.h = p.h""",
    "warc_salvage": """SELECT page_id, sha1(coalesce(html, '')) AS digest, true AS kept FROM pages WHERE page_id % 7 <> 0 UNION ALL SELECT NULL, NULL, true""",
    "op8_repeats": r"""WITH w AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
p AS (SELECT r, i, md5(array_to_string(ws[i:i + 34], ' ')) AS win FROM w, range(1, len(ws) - 33) AS t(i)),
d AS (SELECT win FROM p GROUP BY win HAVING count(*) > 1),
m AS (SELECT DISTINCT r, k FROM p SEMI JOIN d USING (win), range(p.i, p.i + 35) AS t(k)),
x AS (SELECT r, k, ws[k] AS word FROM w, range(1, len(ws) + 1) AS t(k)),
g AS (SELECT x.r, string_agg(word, ' ' ORDER BY x.k) FILTER (m.k IS NULL) AS kept, count(m.k) AS gone FROM x LEFT JOIN m ON m.r = x.r AND m.k = x.k GROUP BY x.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(gone, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN g ON g.r = w.r""",
}
