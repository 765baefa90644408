"""Registered queries against their SQL, and the pipeline against its stages one by one."""

import collections
import hashlib
import re

import duckdb
import pytest
from pyspark.sql.functions import col as c
from tokenizers import Tokenizer

import corpus_pipeline
from tallybook.llm import cases
from tallybook.llm.common import table

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(cases.ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    found, want = cases.QUERIES[name](spark, SMALL).toPandas(), con.execute(cases.ORACLES[name]).df()
    columns = sorted(found.columns)
    assert columns == sorted(want.columns)
    assert sorted(map(repr, found[columns].astype(str).values.tolist())) == sorted(map(repr, want[columns].astype(str).values.tolist()))


def test_pipeline(spark):
    final = {r.doc_id for r in corpus_pipeline.run(spark, SMALL).collect()}
    docs = table(spark, SMALL, "documents")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    scratch = corpus_pipeline.Scratch(spark)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, SMALL), "stage")
        assert docs.columns == columns, name
        now = {r.doc_id for r in docs.collect()}
        assert now <= before
        before = now
    assert final == before and len(final) > 100


def test_all_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{i}_") for n in names) == 1 for i in range(1, 14))


def kept_by_brute_force(rows: list) -> set:
    """doc_ids that stay of rows (doc_id, text): the longest of equal texts, then the first of each component of near ones."""
    best = {}
    for doc_id, text in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        best[norm] = min(best.get(norm, (0, 1 << 60, "")), (-len(text or ""), doc_id, text or ""))
    left = sorted((doc_id, text) for _, doc_id, text in best.values())
    sets = {}
    for doc_id, text in left:
        lower = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in text)
        words = re.findall(r"[^\x20\x09-\x0D]+", lower)
        sets[doc_id] = {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d for d in ids if find(d) == d}


def test_pipeline_equals_brute_force(spark, tmp_path):
    """Exact dedup, near dedup and encoding against brute force, language and mixing against what they promise."""
    docs = table(spark, SMALL, "documents")
    odd = [(10**6, None, "en", "s", 0), (10**6 + 1, "", "en", "s", 0), (10**6 + 2, "12 34", "en", None, 5)]
    more = spark.createDataFrame(odd, "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more.select(*[c(f.name).cast(f.dataType) for f in docs.schema])).union(docs.limit(9)).write.parquet(f"{tmp_path}/documents.parquet")
    scratch, steps = corpus_pipeline.Scratch(spark), []
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES:
        docs = scratch.keep(stage(spark, docs, str(tmp_path)), "stage")
        steps.append(docs.collect())
    spoken, exact, near, mixed, final = steps
    assert not {10**6, 10**6 + 1, 10**6 + 2} & {r.doc_id for r in spoken} and len(spoken) > 150
    want = kept_by_brute_force([(r.doc_id, r.text) for r in spoken])
    assert sorted(r.doc_id for r in near) == sorted(want) and len(exact) > len(near)
    sizes = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in near}
    copies = collections.Counter(r.doc_id for r in mixed)
    assert set(copies) <= want and max(copies.values()) <= 2
    assert sum(sizes[d] * n for d, n in copies.items()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.05)
    texts = {r.doc_id: r.text or "" for r in near}
    tokenizer = Tokenizer.from_file(cases.VOCABULARY)
    assert sorted((r.doc_id, r.n_tokens, r.ids_sha256) for r in final) == sorted(
        (d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        for d, n in copies.items()
        for ids in [tokenizer.encode(texts[d], add_special_tokens=False).ids] * n
    )


def test_pipeline_of_no_documents(spark, tmp_path):
    table(spark, SMALL, "documents").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
