"""Small cases of every corpus operator: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import collections
import hashlib
import math
import random
import re
import types
import weakref
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions
from pyspark.sql.functions import col as c
from tokenizers import Tokenizer

from tallybook.llm import bpe, chat, exact_dedup, jaccard, language, licences, mixing, nearest, pages, sharding
from tallybook.llm.common import ARROW_BYTES, ship, tagged

PATH = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60_000))
ODD = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one  two"), (5, "one  two"), (None, "alpha"), (7, LONG), (8, LONG + " end")]


def rows_of(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


# BPE


@pytest.fixture(scope="module")
def reference():
    tokenizer = Tokenizer.from_file(PATH)
    tokenizer.no_padding()
    tokenizer.no_truncation()
    return tokenizer


def texts_for_bpe():
    rng = random.Random(5)
    letters = "abcdefghij xyz  '.,!0129éèñßüœ\n\tΣσÅ漢😀<|>"
    made = ["".join(rng.choice(letters) for _ in range(rng.randint(0, 80))) for _ in range(400)]
    return made + ["", "don't we'll I'M", "ΑΣ İ", "a" * 500, "x1c\x1d a\x85b", "<|startoftext|>Hi<|endoftext|>", "it's 's's", LONG[:20_000]]


def test_bpe_equals_the_library(reference):
    encoder = bpe.Encoder(PATH, known=200)
    for text in texts_for_bpe():
        ids = reference.encode(text, add_special_tokens=False).ids
        assert encoder.encode(text) == ids
        assert encoder.decode(ids) == reference.decode(ids, skip_special_tokens=False)


def test_bpe_shared_prefixes_give_what_single_words_give():
    vocabulary = bpe.Vocabulary(PATH)
    vocabulary.check()
    words = ["a", "ab", "abc", "abcd", "abd", "therein", "thereinafter", "thereof", "zzzz"]
    together = bpe.PrefixTrie(vocabulary).encode(words)
    assert together == {w: bpe.PrefixTrie(vocabulary).encode([w])[w] for w in words}


def test_bpe_rows(documents, reference):
    found = bpe.encoded_digests(documents(ODD), PATH).collect()
    assert len(found) == len(ODD)
    for row, (_, text) in zip(sorted(found, key=repr), sorted(ODD, key=repr)):
        assert row is not None
    texts = {i: t or "" for i, t in ODD}
    for row in found:
        ids = reference.encode(texts[row.doc_id], add_special_tokens=False).ids
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        decoded = reference.decode(ids, skip_special_tokens=False)
        assert row.decoded_sha256 == hashlib.sha256(decoded.encode()).hexdigest()
    assert bpe.encoded_digests(documents([]), PATH).count() == 0
    both = bpe.encoded(documents(ODD[3:5]), PATH).collect()
    assert all(r.decoded == reference.decode(r.ids, skip_special_tokens=False) for r in both)


# Nearest neighbours


def test_nearest_against_brute_force(table):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((3000, 16)).astype("float32")
    x[100:200] = x[100] + 0.01 * rng.standard_normal((100, 16))
    vectors = [(i, v.tolist(), 0) for i, v in enumerate(x)]
    odd = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (None, x[1].tolist(), 0), vectors[7]]
    frame = table(vectors + odd, "vec_id long, embedding array<float>, key int")
    found = collections.defaultdict(list)
    for r in nearest.nearest(frame).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    hits = 0
    assert set(found) == set(range(0, 3000, 50))
    for q, got in found.items():
        score = unit @ unit[q]
        score[q] = -9
        assert len(got) == 5 and all(abs(score[i] - s) < 1e-12 for i, s in got)
        hits += len({i for i, _ in got} & set(np.argsort(-score)[:5]))
    assert hits / (5 * len(found)) >= 0.9


def test_nearest_with_few_rows(table):
    frame = table([(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [-1.0, 0.0]), (3, [1.0])], "vec_id long, embedding array<double>")
    assert rows_of(nearest.nearest(frame), "query_id", "rank", "vec_id", "score") == [(0, 1, 1, 1.0), (0, 2, 2, -1.0)]
    assert nearest.nearest(table([], "vec_id long, embedding array<double>")).count() == 0


# Exact duplicates


@pytest.mark.parametrize("capacity", [1, 2, 50_000])
def test_exact_duplicates(documents, capacity):
    rows = [*ODD, (9, "onetwo"), (10, "one two "), *[(i, "copy of this") for i in range(100, 140)]]
    found = exact_dedup.exact_duplicates(documents(rows), capacity).collect()
    groups = collections.defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((-len(t or ""), i if i is not None else 10**9, i))
    assert len(found) == len(rows)
    by_hash = {hashlib.sha256(k.encode()).hexdigest(): (min(g)[2], len(g)) for k, g in groups.items()}
    assert all((r.keep_id, r.group_size) == by_hash[r.text_sha256] for r in found)
    kept = [r.text_sha256 for r in found if r.kept]
    assert sorted(kept) == sorted(by_hash) and all(r.doc_id == r.keep_id for r in found if r.kept)
    stay = exact_dedup.without_exact_duplicates(documents(rows), capacity)
    assert stay.count() == len(groups) and stay.columns == documents(rows).columns
    assert exact_dedup.exact_duplicates(documents([])).count() == 0


def test_overfull_buckets_split(documents):
    entries = exact_dedup._entries(exact_dedup.tagged(documents([(i, f"text {i}") for i in range(500)])))
    buckets = exact_dedup.directory(entries, 20).join(entries.withColumn("slot", exact_dedup._slot("h")), "slot")
    assert buckets.groupBy("bucket").count().agg({"count": "max"}).first()[0] <= 20
    assert buckets.count() == 500 and buckets.filter("pages <> 1").count() == 0


# Chat


def test_chat(table):
    rows = [
        (0, 0, "user", "q", 1), (0, 1, "assistant", "yes", 1), (1, 0, "user", "q", 1), (1, 1, "assistant", "no", 1), (1, 2, None, None, 1),
        (2, None, "user", "late", 1), (2, 3, "user", "first", 1), (3, 0, "user", "x", 1), (4, 0, "user", "alone", 1),
        (6, 0, "user", "same", 1), (7, 0, "user", "same", 1), (None, 0, "user", "lost", 1),
    ]
    frame = table(rows, "conv_id long, turn long, role string, text string, chosen int")
    found = {r.chosen_id: r for r in chat.formatted(frame, chat.neighbouring_pairs(frame)).collect()}
    assert set(found) == {0, 2, 6}
    r = found[0]
    assert (r.n_common, r.prompt) == (1, "<|user|>\nq<|end|>\n")
    assert r.chosen == "<|assistant|>\nyes<|end|>\n" and r.rejected == "<|assistant|>\nno<|end|>\n<||>\n<|end|>\n"
    assert [r.chosen[m.start : m.end] for m in r.chosen_masks] == ["yes<|end|>\n"]
    assert [r.rejected[m.start : m.end] for m in r.rejected_masks] == ["no<|end|>\n"]
    assert found[2].n_common == 0 and found[2].chosen.index("first") < found[2].chosen.index("late")
    assert (found[6].chosen, found[6].rejected, found[6].chosen_masks) == ("", "", [])
    empty = table([], "conv_id long, turn long, role string, text string")
    assert chat.formatted(empty, chat.neighbouring_pairs(empty)).count() == 0


# Sharding


def test_flow_is_cheapest():
    flow = sharding.min_cost_flow([10, 2, 0], [4, 4, 4], lambda i, j: 0 if i == j else 1)
    assert sum(flow.values()) == 12 and sum(v for (i, j), v in flow.items() if i != j) == 6
    assert sharding.min_cost_flow([3, 3], [3, 3], lambda i, j: abs(i - j)) == {(0, 0): 3, (1, 1): 3}
    with pytest.raises(ValueError):
        sharding.min_cost_flow([5], [4], lambda i, j: 0)


def test_reshard(documents):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(1, 3000)) for i in range(3000)] + [(i, "same text " * 40) for i in range(3000, 4000)]
    rows += [(4000, None), (4001, ""), (4002, "é"), (4002, "é"), (None, "null id")]
    found = sharding.reshard(documents(rows)).collect()
    assert len(found) == len(rows)
    size = collections.Counter()
    slots = collections.defaultdict(list)
    for r in found:
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert r.law == "bytes" and r.grown_shard is None
    assert set(size) == set(range(24)) and max(size.values()) - min(size.values()) <= 3008
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = sorted((i if i is not None else -1, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.text_crc32) for r in found) == want
    assert sharding.reshard(documents([])).count() == 0


def test_only_affected_shards_are_written(spark, tmp_path):
    root = str(tmp_path / "shards")
    rows = [(i, "t" * 50 + str(i), 0 if i < 300 else 1 + i % 2) for i in range(500)] + [(i, "t" * 50 + str(i), 3) for i in range(500, 667)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, shard int").selectExpr("*", "0 AS v")
    frame.write.partitionBy("shard", "v").parquet(root)
    wrote = sharding.rewrite_affected(spark, root, 4, 4, 1)
    now = spark.read.parquet(root)
    latest = now.groupBy("shard").agg({"v": "max"}).collect()
    current = [r for s, v in latest for r in now.filter(f"shard = {s} AND v = {v}").collect()]
    assert sorted(r.doc_id for r in current) == list(range(667))
    assert {s for s, v in latest if v == 1} <= set(wrote)
    counts = collections.Counter(r.shard for r in current)
    assert max(counts.values()) - min(counts.values()) <= 3


# Pages


def page(article, nav="Home News", extra=""):
    return (
        f"<html><head><title>T</title></head><body><nav><ul><li>{nav}</li></ul></nav>{extra}<article>{article}</article>"
        "<footer>&copy; x</footer><script>var a='<p>';</script></body></html>"
    )


def test_pages(table):
    rows = [
        (1, "http://a.example/1", page("<h1>A &amp; B</h1><p>one<br>two<p>three <b>x</b>")),
        (2, "http://a.example/2", page("<p>cut off")[:-60].split("</article>")[0]),
        (3, None, None), (4, "http://a.example/4", ""), (5, "bad url", "plain &lt; text"), (5, "bad url", "plain &lt; text"),
        (6, "http://a.example/6", page("<p>" + "long word " * 50_000)),
    ]
    frame = table([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    found = {r.page_id: r for r in pages.main_texts(frame).collect()}
    assert found[1].text == "A & B\none two\nthree x" and found[1].n_chars == 21
    assert found[2].text == "cut off" and found[3].text == "" == found[4].text and found[5].text == "plain < text"
    assert found[6].n_chars == 10 * 50_000 - 1
    assert pages.main_texts(frame).count() == 7
    assert pages.main_texts(frame.limit(0)).count() == 0


def test_repeated_branches_go_and_told_once_stay(table):
    rows = [
        (i, f"http://site.example/{i}", f"<body><div class=top><p>Same on all</p></div><div class=text><p>Only page {i} says {i * 7}</p></div></body>")
        for i in range(12)
    ]
    rows.append((99, "http://alone.example/", "<body><div class=top><p>Same on all</p></div><div class=text><p>x</p></div></body>"))
    found = {r.page_id: r.text for r in pages.main_texts(table(rows, "page_id long, url string, html string")).collect()}
    assert all(found[i] == f"Only page {i} says {i * 7}" for i in range(12))
    assert found[99] == "Same on all\nx"


# Language


def language_rows(n=240):
    rng = random.Random(2)
    parts = {"de": "ung keit schen ich der", "en": "tion the ing and wh", "fr": "eau eux ment que oi"}
    rows = []
    for i in range(n):
        lang = list(parts)[i % 3]
        rows.append((i, " ".join("".join(rng.choice(parts[lang].split()) for _ in range(rng.randint(1, 3))) for _ in range(40)), lang))
    return rows


def test_language(documents):
    rows = language_rows()
    more = [(900, None, "de"), (901, "", "en"), (902, "123 !!", "fr"), (None, "the ing", None), (904, "theing " * 30_000, None)]
    found = {r.doc_id: r for r in language.identified(documents(rows + more)).collect()}
    truth = {i: lang for i, _, lang in rows}
    held = [i for i in truth if found[i].held_out]
    assert held == [i for i in truth if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(found[i].lang_pred == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 for r in found.values())
    assert {found[i].lang_pred for i in (900, 901, 902)} == {"und"} and found[904].lang_pred == "en"
    stay = language.in_a_language(documents(rows + more))
    assert stay.count() == len(rows) + 2 and stay.columns == documents(rows).columns
    assert language.identified(documents([])).count() == 0 and language.in_a_language(documents([])).count() == 0


def test_switched_text_has_both_languages():
    model = language.train([(lang, text) for _, text, lang in language_rows()])
    shares = model.shares(["ungkeitschen derung " * 10 + "theing tionwhing " * 10])[0]
    assert shares[model.labels.index("de")] > 0.3 and shares[model.labels.index("en")] > 0.3


def test_forward_backward_against_all_paths():
    rng = np.random.default_rng(0)
    e, a = rng.standard_normal((1, 4, 3)), rng.standard_normal((3, 3))
    valid = np.array([[True, True, True, False]])
    want, pairs, total = np.zeros((4, 3)), np.zeros((3, 3)), 0.0
    for path in np.ndindex(3, 3, 3):
        p = np.exp(sum(e[0, t, y] for t, y in enumerate(path)) + sum(a[x, y] for x, y in zip(path, path[1:])))
        total += p
        for t, y in enumerate(path):
            want[t, y] += p
        for x, y in zip(path, path[1:]):
            pairs[x, y] += p
    posterior, expected, norm = language.forward_backward(e, a, valid)
    assert np.allclose(posterior[0], want / total) and np.allclose(expected, pairs / total) and np.isclose(norm, np.log(total))


# Mixing


def brute_targets(sizes, share=1.5):
    names = sorted(sizes, key=lambda s: (s is None, s))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        each = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * each > 2 * sizes[s]}
        if not over:
            return target | {s: weight[s] * each for s in open_}
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_mixing(documents):
    rng = random.Random(4)
    rows = [(i, "w " * rng.randint(1, 400), None, rng.choice(["a", "a", "a", "b", "c", "é", None])) for i in range(900)]
    rows += [(1000, None, None, "b"), (1001, "", None, "b"), (1002, "z " * 5, None, "tiny"), (1002, "z " * 5, None, "tiny")]
    found = mixing.mix(documents(rows)).collect()
    size = collections.Counter()
    for _, t, _, s in rows:
        size[s] += len((t or "").split())
    want, taken = brute_targets(size), collections.Counter()
    assert len(found) == len(rows)
    for r in found:
        taken[r.source] += r.taken
        assert r.source_size == size[r.source] and r.target == pytest.approx(want[r.source]) and r.taken <= 2 * r.size
    assert all(abs(taken[s] - want[s]) <= max(5, 0.02 * want[s]) for s in want)
    again = mixing.mix(documents(rows[::-1])).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))
    mixed = mixing.mixed(documents(rows))
    assert mixed.columns == documents(rows).columns
    assert collections.Counter(r.doc_id for r in mixed.collect()) == collections.Counter({r.doc_id: 0 for r in found}) + sum(
        (collections.Counter({r.doc_id: r.copies}) for r in found), collections.Counter()
    )
    assert mixing.mix(documents([])).count() == 0 and mixing.mixed(documents([])).count() == 0


# Licences


def test_licences(documents):
    mit = [s for s, i in licences.SENTENCES.items() if i in ("MitGrant", "MitKeep")]
    rows = [
        (1, "Some text.\nReleased under the MIT License.\nMore"), (2, mit[0] + ":\n\n" + mit[1].replace(" ", "\n  ") + "."),
        (3, "Licensed under the Apache License, Version 2.0. you may not use this file except in compliance with the License."),
        (4, mit[1] + "."), (5, None), (6, ""), (7, LONG), (8, "no period\nLicensed under CC BY-NC 4.0."), (8, "no period\nLicensed under CC BY-NC 4.0."),
    ]
    found = {r.doc_id: (r.sentences, r.licences) for r in licences.scanned(documents(rows)).collect()}
    assert found[1] == (["MitNotice"], ["MIT"]) and found[2] == (["MitGrant", "MitKeep"], ["MIT"])
    assert found[3] == (["ApacheNotice", "ApacheComply"], ["Apache-2.0"]) and found[4] == (["MitKeep"], ["unknown"])
    assert found[5] == found[6] == found[7] == ([], []) and found[8] == (["CcByNc4"], ["CC-BY-NC-4.0"])
    assert licences.scanned(documents(rows)).count() == 9 and licences.scanned(documents([])).count() == 0


# Jaccard join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def brute_components(rows):
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and 100 * both >= 80 * (len(a) + len(sets[j]) - both):
                up[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return [(d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def near_copies():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, rows = [word() for _ in range(60)], []
    for g in range(30):
        base = [word() for _ in range(rng.randint(3, 300))]
        for _ in range(rng.randint(1, 12)):
            copy = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 60))):
                copy[rng.randrange(len(copy))] = word().upper()
            if g % 3 == 0:
                copy += passage
            rows.append((5000 - len(rows), " ".join(copy)))
    star = [word() for _ in range(400)]
    rows.append((1, " ".join(star)))
    for i in range(60):  # each links with the first, not with each other
        copy = list(star)
        for at in rng.sample(range(400), 7):
            copy[at] = word()
        rows.append((100 + i, "\n".join(copy)))
    rows.append((2, " ".join(f"u{i}" for i in range(12))))
    rows.append((3, " ".join(f"u{i}" for i in range(14))))  # 8 of 10 shingles: exactly at the bound
    return rows + ODD + [(50, "One TWO")]


@pytest.mark.parametrize("chunk", [900, 400_000])
def test_jaccard_components(documents, monkeypatch, chunk):
    monkeypatch.setattr(jaccard, "CHUNK", chunk)
    rows = near_copies()
    found = jaccard.jaccard_components(documents(rows)).collect()
    assert sorted(map(tuple, found), key=repr) == sorted(brute_components(rows), key=repr)


def test_copies_alone_are_no_candidates(spark, tmp_path, monkeypatch):
    """Prefix shingles that only copies of one set have are not sent on, in whichever files the copies are."""
    rows = [(100 * k + i, " ".join(f"w{i}x{j}" for j in range(40))) for k in range(3) for i in range(20)]
    path, kept, keep = str(tmp_path / "copies"), {}, jaccard.Scratch.keep
    spark.createDataFrame(rows, "doc_id long, text string").repartition(6).write.parquet(path)

    def noted(self, df, name):
        kept[name] = keep(self, df, name)
        return kept[name]

    monkeypatch.setattr(jaccard.Scratch, "keep", noted)
    found = {r.doc_id: r.component_id for r in jaccard.jaccard_components(spark.read.parquet(path)).collect()}
    assert found == {d: d % 100 for d, _ in rows}
    assert kept["having"].count() == 0


def test_one_of_each_component_stays(documents):
    rows = near_copies()
    stay = jaccard.one_of_each_component(documents(rows))
    want = collections.Counter(c for d, n, c in brute_components(rows) if n)
    kept = collections.Counter(r.doc_id for r in stay.collect())
    empty = collections.Counter(d for d, n, _ in brute_components(rows) if not n)
    assert kept == collections.Counter(dict.fromkeys(want, 1)) + empty and stay.columns == documents(rows).columns


def test_jaccard_of_nothing(documents):
    assert jaccard.jaccard_components(documents([])).count() == 0
    assert jaccard.one_of_each_component(documents([])).count() == 0


def test_pieces_of_a_long_text_give_its_set(monkeypatch):
    text = LONG[:200_000].encode()
    whole = jaccard.shingle_sets([text])[0]
    monkeypatch.setattr(jaccard, "PIECE", 1000)
    assert np.array_equal(whole, jaccard.shingle_sets([text])[0])


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(-40, 60)] + [(100, 101)], "u long, v long")
    roots = {r.x: r.root for r in jaccard.components(edges, jaccard.Scratch(spark)).collect()}
    assert set(roots[i] for i in range(-40, 61)) == {-40} and roots[101] == roots[100] == 100


def test_words_without_a_letter_have_no_language():
    model = language.train([("en", "the cat sat on the mat"), ("de", "die Katze lag auf der Matte")])
    found = language._labelled(model, pd.Series(["²³ ½", "12 34", None, "", "the cat", "² Katze"]))
    assert found["lang_pred"].tolist() == ["und"] * 4 + ["en", "de"]
    assert (found["score"][:4] == 0).all() and (found["score"][4:] > 0).all()


def test_tags_belong_to_the_stored_rows(spark, tmp_path):
    path = str(tmp_path / "rows")
    spark.range(20_000).withColumn("text", c("id").cast("string")).repartition(5).write.parquet(path)
    old = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.leafNodeDefaultParallelism")}
    found = []
    for size, cores in (("4k", "8"), ("128m", "2")):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", cores)
        rows = tagged(spark.read.parquet(path).select("id", "text"))
        found.append((rows.rdd.getNumPartitions(), {(r.id, r._tag) for r in rows.select("id", "_tag").collect()}))
    for key, value in old.items():
        spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert found[0][0] != found[1][0] and found[0][1] == found[1][1]
    assert len({tag for _, tag in found[0][1]}) == 20_000


@pytest.mark.parametrize("keep", [exact_dedup.without_exact_duplicates, jaccard.one_of_each_component])
def test_a_column_called_tag_stays(table, keep):
    rows = table([(1, "one two three", 7), (2, "one two three", 8), (3, None, 9)], "doc_id long, text string, _tag long")
    left = keep(rows)
    assert left.columns == ["doc_id", "text", "_tag"] and sorted(r._tag for r in left.collect()) == [7, 9]


def page_of_divs(rnd, n: int) -> tuple[str, str]:
    """A page without telling elements and names, and its text: top and end are the host's, the middle is its own."""
    words = [f"w{rnd.randrange(10**6)}" for _ in range(60)]
    parts = [" ".join(words[i : i + 15]) for i in range(0, 60, 15)][: 1 + n % 4]
    top = "".join(f"<div><a href='/{x}'>{x}</a></div>" for x in ("home", "news", "shop"))
    end = "<div><div>All rights reserved</div><div>Imprint</div></div>"
    middle = "".join(f"<{e}>{p}</{e}>" for e, p in zip(("p", "blockquote", "p", "pre"), parts))
    return f"<html><body><div>{top}</div><div><div>{middle}</div></div>{end}</body></html>", "\n".join(parts)


def test_the_tree_alone_finds_the_text(table):
    rnd = random.Random(4)
    made = [page_of_divs(rnd, n) for n in range(30)]
    rows = [(n, "https://plain.example/%d" % n, html) for n, (html, _) in enumerate(made)]
    found = pages.main_texts(table(rows, "page_id long, url string, html string")).collect()
    assert {r.page_id: r.text for r in found} == {n: text for n, (_, text) in enumerate(made)}


def test_two_pages_of_a_host_have_a_tree(table):
    html = "<body><div><div>Home</div><div>Shop</div></div><div><p>%s</p></div></body>"
    rows = [(1, "https://two.example/1", html % "first text"), (2, "https://two.example/2", html % "second text")]
    found = pages.main_texts(table(rows + [(3, "https://one.example/", html % "third")], "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in found.collect()} == {1: "first text", 2: "second text", 3: "Home\nShop\nthird"}


@pytest.mark.parametrize(
    "html,text",
    [
        ('<article class="post ad-free"><p>a</p></article>', "a"),
        ('<article><h2 id="comments-on-method">b</h2><p>c</p></article>', "b\nc"),
        ('<article><section class="related"><p>d</p></section></article>', "d"),
        ('<article><p class="social policy">e</p></article>', "e"),
        ("<article><p>f <math>x + 1</math> <object>g</object></p></article>", "f x + 1 g"),
        ('<article><p>h</p><div class="ad">i</div><div class="site-footer">j</div><div id="comments">k</div></article>', "h"),
        ('<div class="top-menu">l</div><article><p>m</p><div class="reader-comments">n</div></article><div role="banner">o</div>', "m"),
    ],
)
def test_names_say_what_is_no_content(table, html, text):
    rows = [(1, "https://one.example/1", f"<html><body>{html}</body></html>")]
    assert pages.main_texts(table(rows, "page_id long, url string, html string")).first().text == text


def test_importance_equals_a_plain_count(spark, table):
    """Presentation and content importance of every node of a host, counted page by page."""
    rnd = random.Random(8)
    sources = [page_of_divs(rnd, n)[0] for n in range(12)]
    parsed = [pages.Page(s) for s in sources]
    styles, texts, on = (collections.defaultdict(collections.Counter) for _ in range(3))
    for i, page in enumerate(parsed):
        for (key, *_), seen in zip(page.nodes, page.children):
            on[key][i] += 1
            styles[key].update(seen)
        for node, text in page.blocks:
            texts[page.nodes[node][0], text][i] += 1

    def entropy(counts, base):
        total = sum(counts)
        return -sum(n / total * math.log(n / total) for n in counts) / math.log(base)

    rows = [(1 + i, "https://h.example/", s) for i, s in enumerate(sources)]
    frame = tagged(table(rows, "page_id long, url string, html string"))
    parse = functions.pandas_udf(pages._parse, pages._PARSED)
    numbers = frame.select("_tag", functions.lit("h").alias("host"), parse("html").alias("p")).select("_tag", "host", "p.*")
    found = {r.key: r for r in pages._importance(numbers).collect()}
    assert set(found) == set(on)
    for key, r in found.items():
        m = len(on[key])
        assert r.pages == m and r.styles == len(styles[key])
        if m > 1:
            assert r.presentation == pytest.approx(min(1.0, entropy(styles[key].values(), m)))
            spread = [entropy(x.values(), m) for (k, _), x in texts.items() if k == key]
            assert r.content is None if not spread else r.content == pytest.approx(1 - sum(spread) / len(spread))


def test_without_languages_to_learn_from_all_rows_stay(documents):
    assert language.in_a_language(documents([(1, "some words", None), (2, None, None)])).count() == 2


def test_swapped_answers_share_their_prompt(table):
    turns = [
        (1, 0, "user", "q1"), (1, 1, "assistant", "a1"), (1, 2, "user", "q2"), (1, 3, "assistant", "a2"), (1, 4, "user", None),
        (2, 0, "user", "q3"), (2, 1, "assistant", "a3"), (3, 0, "user", "q4"), (3, 1, "assistant", "a3"),
        (4, 0, "user", "alone"), (6, 0, "assistant", "x" * 100_000), (None, 0, "assistant", "lost"), (7, None, None, None),
    ]
    conversations = table([(*t, "clash") for t in turns], "conv_id long, turn int, role string, text string, chosen string")
    rows = {r.chosen_id: r for r in chat.swapped_answers(conversations).collect()}
    assert set(rows) == {1, 2}
    first = rows[1]
    assert (first.rejected_id, first.n_common) == (2, 3)
    assert first.prompt == "<|user|>\nq1<|end|>\n<|assistant|>\na1<|end|>\n<|user|>\nq2<|end|>\n"
    assert first.chosen == "<|assistant|>\na2<|end|>\n<|user|>\n<|end|>\n" and first.rejected == "<|assistant|>\na3<|end|>\n"
    assert [tuple(m) for m in first.chosen_masks] == [(14, 24)] == [tuple(m) for m in first.rejected_masks]
    # Equal answers: nothing is left to tell apart.
    assert (rows[2].n_common, rows[2].rejected) == (2, "")
    assert chat.swapped_answers(conversations.limit(0)).count() == 0


@pytest.mark.parametrize("capacity", [3, 50_000])
def test_texts_of_one_hash_are_told_apart_by_their_bytes(documents, monkeypatch, capacity):
    """A hash of two bits: each chain holds many texts, on one page or on many."""
    monkeypatch.setattr(exact_dedup, "hashed", lambda norm: functions.pmod(functions.xxhash64(norm), functions.lit(4)) - 2)
    rows = [(i, f"text {i % 40}" + " " * (i % 3)) for i in range(200)]
    found = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.exact_duplicates(documents(rows), capacity).collect()}
    groups = collections.defaultdict(list)
    for i, text in rows:
        groups[text.replace(" ", "")].append((-len(text), i))
    assert found == {i: (min(g)[1], len(g)) for g in groups.values() for _, i in g}


def test_groups_come_from_the_index(documents, monkeypatch):
    """Without its links there are no groups."""
    links = exact_dedup._links
    monkeypatch.setattr(exact_dedup, "_links", lambda *a: links(*a).filter("false"))
    assert exact_dedup.exact_duplicates(documents([(1, "a"), (2, "a")])).count() == 0


def python_functions(monkeypatch, build):
    """What ``build`` gives to Python tasks, called here on one batch of texts."""
    found, make = [], functions.pandas_udf
    monkeypatch.setattr(functions, "pandas_udf", lambda f, kind: found.append(f) or make(f, kind))
    build()
    return found


def test_an_encoder_goes_when_another_operator_takes_its_worker(documents, monkeypatch):
    docs, rank = documents([(1, "one two", "en"), (2, "eins zwei", "de")]), types.SimpleNamespace(value=np.zeros(1 << jaccard.COUNT_BITS, np.uint8))
    builds = {
        "language": lambda: language.in_a_language(documents([(i, "one two" if i % 2 else "eins zwei", "en" if i % 2 else "de") for i in range(40)])),
        "jaccard": lambda: jaccard._prefixes(tagged(docs), rank),
    }
    for name, build in builds.items():
        run = python_functions(monkeypatch, build)[-1]
        encoder = bpe.loaded(PATH)
        encoder.learn({"one"})
        assert bpe.loaded(PATH) is encoder, "its own tasks share it"
        left = weakref.ref(encoder)
        del encoder
        texts = pd.Series(["one two"]) if name == "language" else pd.Series([b"one two"])
        assert len(next(iter(run(iter([texts]))))) == 1
        assert left() is None, name


def test_batches_of_long_texts_are_bounded_by_bytes(spark, table):
    ship(spark)
    size = ARROW_BYTES // 8
    docs = table([(i, "x" * size) for i in range(40)], "doc_id long, text string").coalesce(1)
    batches = docs.mapInPandas(lambda parts: (pd.DataFrame({"n": [p["text"].str.len().sum()]}) for p in parts), "n long")
    sizes = [r.n for r in batches.collect()]
    assert sum(sizes) == 40 * size and max(sizes) <= ARROW_BYTES + size
