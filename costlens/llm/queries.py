"""The registered queries of the operators.  Each applies its operator to the whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from costlens.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return deco


@_query("op10_sharding")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.llm.sharding import shard_documents

    out = shard_documents(table(spark, sf_dir, "documents"), shards=24)
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@_query("op3_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


@_query("op1_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


@_query("op2_pii")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.llm.pii import find_pii

    found = find_pii(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


@_query("op9_simhash")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.llm.simhash import simhash_duplicates

    return simhash_duplicates(table(spark, sf_dir, "documents"), words=3, bits=3)


@_query("op6_quality")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.llm.quality import quality_report, train

    docs = table(spark, sf_dir, "documents")
    found = quality_report(docs, train(docs, table(spark, sf_dir, "labels")))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@_query("op4_lm")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.llm.lm import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@_query("op5_embeddings")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.llm.embeddings import vector_duplicates

    return vector_duplicates(table(spark, sf_dir, "embeddings"))


@_query("op7_licenses")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.llm.licenses import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents"))
    told = F.concat_ws(
        ",",
        F.transform(
            "notices",
            lambda s: F.concat_ws(":", s["license"], s["start"].cast("string"), s["end"].cast("string")),
        ),
    )
    return found.select("doc_id", "n_notices", "best", "coverage", told.alias("notices"))


@_query("op8_urls")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.llm.urls import judge_urls

    found = judge_urls(table(spark, sf_dir, "pages"))
    return found.select("page_id", "host", "path", "rule", "verdict", "score")


def merkle_sql(heights: int = 8) -> str:
    """The manifest in SQL: `heights` levels (16 to that power leaves a source), passed on once a tree has one node."""

    def field(c: str) -> str:
        return f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"

    def leaf(text: str) -> str:
        return "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"

    def tree(stem: str) -> list[str]:
        """Levels 1 to `heights` above {stem}0 (tree, i, h), and each level's nodes with what is left and right in their runs."""
        out = []
        for k in range(heights):
            run = "PARTITION BY tree, i // 16 ORDER BY i ROWS BETWEEN"
            out.append(
                f"""{stem}r{k} AS (SELECT tree, i, h, count(*) OVER (PARTITION BY tree) AS n,
  coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS l,
  coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS r FROM {stem}{k})"""
            )
            out.append(
                f"""{stem}{k + 1} AS (SELECT tree, i // 16 AS i,
  CASE WHEN max(n) = 1 THEN max(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {stem}r{k} GROUP BY tree, i // 16)"""
            )
        return out

    def climb(stem: str, start: str, index: str) -> list[str]:
        """f0 to f{heights}: the folded digest and the proof so far, level by level."""
        out = []
        for k in range(heights):
            before = start if k == 0 else f"{stem}f{k - 1}"
            out.append(
                f"""{stem}f{k} AS (SELECT d.* EXCLUDE (fold, proof, {index}), d.{index} // 16 AS {index},
  CASE WHEN t.n = 1 THEN d.fold ELSE sha256(t.l || d.fold || t.r) END AS fold, d.proof || t.l || t.r AS proof
  FROM {before} d JOIN {stem}r{k} t ON t.tree = d.{"tree" if stem == "s" else "top"} AND t.i = d.{index})"""
            )
        return out

    crc = """xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, j: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"""docs AS (SELECT doc_id, coalesce('=' || source, '') AS tree, '' AS top, {leaf("text")} AS leaf,
  CASE WHEN {crc} % 5 = 0 THEN {leaf(lower)} ELSE {leaf("text")} END AS fold, '' AS proof FROM documents)""",
        """placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM docs)""",
        "s0 AS (SELECT tree, i, leaf AS h FROM placed)",
        *tree("s"),
        f"subroots AS (SELECT tree, h AS subroot, row_number() OVER (ORDER BY tree) - 1 AS place FROM s{heights})",
        "t0 AS (SELECT '' AS tree, place AS i, subroot AS h FROM subroots)",
        *tree("t"),
        *climb("s", "placed", "i"),
        f"under AS (SELECT d.* EXCLUDE (i), s.subroot, s.place FROM sf{heights - 1} d JOIN subroots s ON s.tree = d.tree)",
        *climb("t", "under", "place"),
    ]
    return f"""WITH {", ".join(parts)}
SELECT d.doc_id, d.leaf, d.subroot, r.h AS root, sha256(d.proof) AS proof_sha256, d.fold AS folded_root, d.fold = r.h AS verified
FROM tf{heights - 1} d JOIN t{heights} r ON true"""


@_query("op11_merkle", merkle_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from string import ascii_lowercase, ascii_uppercase

    from costlens.llm.merkle import build_manifest, leaf_digest, prove

    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", ascii_uppercase, ascii_lowercase)
    changed = leaf_digest([docs[c] for c in ("doc_id", "source", "lang", "n_chars")] + [lower])
    tampered = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    return prove(build_manifest(docs, presented=F.when(tampered, changed)))


@_query("op12_langid")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.llm.langid import held_out, identify, train

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, train(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Lines are counted by their ends; a cut of r lines is as long as these lines with their ends.
FIM_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
l AS (SELECT doc_id, t, string_split(t, chr(10)) AS u,
  CASE WHEN t = '' THEN 0 ELSE length(t) - length(replace(t, chr(10), '')) + (NOT ends_with(t, chr(10)))::BIGINT END AS n,
  ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM d),
c AS (SELECT doc_id, t, u, n, least(h1 % (n + 1), h2 % (n + 1)) AS r1, greatest(h1 % (n + 1), h2 % (n + 1)) AS r2,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
    WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM l),
a AS (SELECT doc_id, t, n, form,
  least(length(t), coalesce(list_sum(list_transform(u[1:r1], lambda x: length(x) + 1)), 0))::BIGINT AS p,
  least(length(t), coalesce(list_sum(list_transform(u[1:r2], lambda x: length(x) + 1)), 0))::BIGINT AS q FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN t
  WHEN 'psm' THEN '<P>' || substring(t, 1, p) || '<S>' || substring(t, q + 1) || '<M>' || substring(t, p + 1, q - p)
  ELSE '<S>' || substring(t, q + 1) || '<P>' || substring(t, 1, p) || '<M>' || substring(t, p + 1, q - p) END AS out FROM a)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN p END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN q - p END AS middle_chars, sha256(out) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""


@_query("op13_fim", FIM_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from costlens.llm.fim import fill_in_middle, hashed

    found = fill_in_middle(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        "n",
        "form",
        "prefix_chars",
        "middle_chars",
        hashed("output").alias("output_sha256"),
        hashed("restored").alias("restored_sha256"),
    )
