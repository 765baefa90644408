"""The queries of this folder, each over its whole table, and their SQL where there is any."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import (
    alignment, bpe, chat, exact_dedup, jaccard, language, licences, mixing, nearest, pages, sharding, spelling, token_files,
)
from tallybook.llm.common import table
from tallybook.session import scratch_folder

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
BYTE_VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encoded_digests(table(spark, sf_dir, "documents"), VOCABULARY)


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.nearest(table(spark, sf_dir, "embeddings"))


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks as text: start-end pairs joined by commas."""
    found = chat.swapped_answers(table(spark, sf_dir, "conversations"))

    def listed(masks):
        pair = F.transform(masks, lambda m: F.concat_ws("-", m["start"], m["end"]))
        return F.array_join(pair, ",")

    return found.withColumns({c: listed(c) for c in ("chosen_masks", "rejected_masks")})


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.reshard(table(spark, sf_dir, "documents"))


def op6_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_texts(table(spark, sf_dir, "pages"))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identified(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op9_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers and licences joined by commas."""
    found = licences.scanned(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.array_join(c, ",") for c in ("sentences", "licences")})


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf_dir, "documents"))


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch_folder(spark)}/tokens"
    token_files.write_token_files(table(spark, sf_dir, "documents"), folder, BYTE_VOCABULARY)
    return token_files.file_digests(spark, folder)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.alignment_digests(table(spark, sf_dir, "documents"), BYTE_VOCABULARY, PIECES)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_bpe,
        op2_nearest,
        op3_exact_dedup,
        op4_chat,
        op5_sharding,
        op6_pages,
        op7_language,
        op8_mixing,
        op9_licences,
        op10_jaccard_join,
        op11_spelling,
        op12_token_files,
        op13_alignment,
    )
}

ORACLES: dict[str, str] = {
    "op3_exact_dedup": r"""
        WITH n AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        )
        SELECT doc_id,
               first_value(doc_id) OVER w AS keep_id,
               count(*) OVER (PARTITION BY norm) AS group_size,
               row_number() OVER w = 1 AS kept,
               sha256(norm) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY norm ORDER BY length(text) DESC, doc_id)
    """,
    "op4_chat": r"""
        WITH t AS (
            SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS pos
            FROM conversations WHERE conv_id IS NOT NULL
        ),
        l AS (SELECT conv_id, max(pos) AS last, arg_max(text, pos) AS answer FROM t WHERE role = 'assistant' GROUP BY conv_id),
        p AS (
            SELECT a.conv_id AS chosen_id, b.conv_id AS rejected_id, a.last, a.answer, b.answer AS other
            FROM l a JOIN l b ON b.conv_id = a.conv_id + 1
        ),
        n AS (
            SELECT p.*, CASE WHEN answer = other THEN last ELSE last - 1 END::INT AS n_common FROM p
        ),
        turns AS (
            SELECT chosen_id, rejected_id, n_common, true AS is_chosen, pos, role, text FROM n JOIN t ON conv_id = chosen_id
            UNION ALL
            SELECT chosen_id, rejected_id, n_common, false, pos, role, CASE WHEN pos < last THEN text ELSE other END
            FROM n JOIN t ON conv_id = chosen_id WHERE pos <= last
        ),
        s AS (
            SELECT turns.*,
                   '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS piece,
                   sum(CASE WHEN pos > n_common THEN length(role) + length(text) + 13 ELSE 0 END)
                       OVER (PARTITION BY chosen_id, is_chosen ORDER BY pos) AS stop,
                   length(text) + 8 AS own
            FROM turns
        )
        SELECT chosen_id, rejected_id, n_common,
               coalesce(string_agg(piece, '' ORDER BY pos) FILTER (is_chosen AND pos <= n_common), '') AS prompt,
               coalesce(string_agg(piece, '' ORDER BY pos) FILTER (is_chosen AND pos > n_common), '') AS chosen,
               coalesce(string_agg(piece, '' ORDER BY pos) FILTER (NOT is_chosen AND pos > n_common), '') AS rejected,
               coalesce(string_agg((stop - own)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY pos)
                   FILTER (is_chosen AND pos > n_common AND role = 'assistant'), '') AS chosen_masks,
               coalesce(string_agg((stop - own)::BIGINT || '-' || stop::BIGINT, ',' ORDER BY pos)
                   FILTER (NOT is_chosen AND pos > n_common AND role = 'assistant'), '') AS rejected_masks
        FROM s GROUP BY ALL
    """,
    "op9_licences": licences.oracle(),
}
