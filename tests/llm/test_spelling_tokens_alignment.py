"""Spelling variants, token files and alignment against brute force, on small cases of every kind."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tallybook.llm import alignment, byte_bpe, spelling, token_files
from tallybook.llm.common import Scratch

BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "one  two"), (5, "one  two"), (6, "日本語 テスト"), (7, LONG),
    (8, "a▁b"), (9, "<s>x</s><unk> <0x41>"), (10, "a<|endoftext|>b"), (11, "\x00y﻿ é é"), (12, "tab\tx  y   "),
]


# -- spelling ---------------------------------------------------------------------------------------------------------


def one_edit(a: str, b: str) -> bool:
    a, b = sorted((a, b), key=len)
    if a == b or len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def counted(rows) -> dict[str, int]:
    n = collections.Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            n[word] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def forms(words: dict[str, int]) -> set[tuple]:
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-words[x], x), default=None)
        if best is not None and words[best] >= 5 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return {(w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items()}


def some_texts(seed: int) -> list[tuple]:
    rnd = random.Random(seed)
    words = ["".join(rnd.choices("aberé", k=rnd.randrange(5, 9))) for _ in range(80)]
    words += [w[:3] + w[4:] for w in words] + [w[:2] + "z" + w[2:] for w in words] + [w.upper() for w in words]
    words += ["Öffnung", "öffnung", "x" * 300, "y" * 299, "÷plus×"]
    texts = [" ".join(rnd.choices(words, weights=[1 + (i % 7) ** 3 for i in range(len(words))], k=400)) for _ in range(12)]
    return list(enumerate(texts)) + [(3, texts[3]), (None, texts[0]), (50, None), (51, ""), (52, "ı日本 Ÿ"), (53, LONG)]


def test_forms_equal_brute_force(spark, documents):
    rows = some_texts(1)
    found = {tuple(r) for r in spelling.spelling_forms(documents(rows)).collect()}
    assert found == forms(counted(rows)) and any(r[1] for r in found) and len(found) > 100


def test_no_texts_give_no_words(spark, documents):
    assert spelling.spelling_forms(documents([(1, None), (2, "")])).count() == 0
    assert spelling.spelling_forms(documents([])).count() == 0


@pytest.mark.parametrize("frequent", [1, 5, 50, 2000])
def test_lists_lose_no_pair(monkeypatch, frequent):
    """Also for words so short that an edit may affect all their grams: these meet in their halves."""
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    rnd, few = random.Random(frequent), 0
    for _ in range(40):
        letters = rnd.choice(["ab", "abc", "abcdefgh", "aé"])
        words = {"".join(rnd.choices(letters, k=rnd.randrange(1, 9))) for _ in range(120)}
        words = sorted(words | {w + letters[0] for w in words})
        dictionary = dictionary_of(words)
        _, _, number, affected = dictionary.decompose(spelling.framed(words))
        few += int((number - affected < 1).sum())
        lists, entries = collections.defaultdict(list), list(zip(*[x.tolist() for x in dictionary.lists(words)]))
        for word, gram, place in entries:
            lists[gram, place, len(words[word])].append(word)
        met = set()
        for word, gram, place in entries:
            n = len(words[word])
            for key in ((gram, place, n), (gram, place, n + 1), (gram, place + 1, n + 1)):
                met |= {frozenset((word, x)) for x in lists.get(key, ()) if one_edit(words[word], words[x])}
        assert met == {frozenset((i, j)) for i, a in enumerate(words) for j, b in enumerate(words[:i]) if one_edit(a, b)}
    assert few


def dictionary_of(words):
    found, kept = spelling.framed(words), []
    positions = (found.grams[2] >= 0).sum()
    for k in range(spelling.LEAST, spelling.MOST + 1):
        grams, n = np.unique(found.grams[k][found.grams[k] >= 0], return_counts=True)
        frequent = dict(zip(grams.tolist(), (n * spelling.FREQUENT > positions).tolist()))
        own = np.array([k == spelling.LEAST or before[g >> 8] for g in grams.tolist()], bool)
        kept.append((np.full(own.sum(), k), grams[own], n[own]))
        before = frequent
    return spelling.GramDictionary(*map(np.concatenate, zip(*kept)))


def test_the_dictionary_is_pruned_by_frequency(spark, monkeypatch):
    words = sorted(counted(some_texts(2)))
    monkeypatch.setattr(spelling, "FREQUENT", 200)
    made = spelling.gram_dictionary(spark.createDataFrame([(w, 9) for w in words], "word string, n long"), Scratch(spark))
    want = dictionary_of(words)
    for k in range(spelling.LEAST, spelling.MOST + 1):
        assert made.grams[k].tolist() == want.grams[k].tolist() and made.counts[k].tolist() == want.counts[k].tolist()
    everything = spelling.framed(words).grams
    assert 0 < len(made.grams[4]) < len(np.unique(everything[4][everything[4] >= 0]))


def test_roots_of_a_long_chain(spark):
    links = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(20)], "word string, form string")
    assert {r.root for r in spelling.roots(links, 5**22, Scratch(spark)).collect()} == {"w20"}


# -- token files ------------------------------------------------------------------------------------------------------


def library(special: bool = True) -> Tokenizer:
    tokenizer = Tokenizer.from_file(BYTES)
    tokenizer.encode_special_tokens = not special
    return tokenizer


def test_every_code_point_is_encoded_as_by_the_library():
    tokenizer, own = library(), byte_bpe.ByteBpe(BYTES)
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c <= 0xDFFF]
    texts = ["".join(f"a{c}1{c}b {c}.{c} " for c in points[i : i + 64]) for i in range(0, len(points), 64)]
    for text, want in zip(texts, tokenizer.encode_batch(texts, add_special_tokens=False)):
        assert own.encode(text).tolist() == want.ids


@pytest.mark.parametrize("special", [True, False])
def test_odd_texts_are_encoded_as_by_the_library(special):
    tokenizer, own = library(special), byte_bpe.ByteBpe(BYTES, special)
    for text in [t or "" for _, t in ODD] + [" " * 1_200_000 + "x", "\n" * 1_200_000, "ab" * 200_000, "'S's 'll don't ''s"]:
        assert own.encode(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_files_hold_all_ids_in_order(spark, documents, tmp_path):
    folder = str(tmp_path / "tokens")
    token_files.write_token_files(documents(ODD[::-1]), folder, BYTES)
    want, start = [], 0
    for doc_id, text in ODD:
        ids = np.array(library().encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(tuple(r) for r in token_files.file_digests(spark, folder).collect()) == want
    stored = token_files.read_token_files(spark, folder, 4, 4).collect()
    assert [r.ids for r in stored] == [library().encode("one two").ids + [0]]


def test_files_have_the_promised_layout(spark, documents, tmp_path):
    folder = str(tmp_path / "layout")
    token_files.write_token_files(documents([(i, f"text {i} " * 30) for i in range(4000)]), folder, BYTES, row_group_bytes=1 << 14, page_rows=100)
    groups = indexed = 0
    for file in sorted((tmp_path / "layout").glob("*.parquet")):
        meta = pq.ParquetFile(file).metadata
        groups += meta.num_row_groups
        for g in range(meta.num_row_groups):
            for c in range(meta.num_columns):
                column = meta.row_group(g).column(c)
                indexed += column.has_offset_index
                kind = "RLE_DICTIONARY" if column.path_in_schema.startswith("ids") else "DELTA_BINARY_PACKED"
                assert kind in column.encodings, (column.path_in_schema, column.encodings)
    assert groups > 4 and indexed == groups * 5
    plan = token_files.read_token_files(spark, folder, 10, 20).select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,10), LessThanOrEqual(doc_id,20)]" in plan
    assert "ids" not in re.search(r"ReadSchema: struct<(.*?)>", plan)[1].replace("doc_id", "")


def test_one_doc_id_of_many_rows_lies_in_several_ranges(spark, documents, tmp_path):
    folder = str(tmp_path / "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    token_files.write_token_files(documents([(None if i % 2 else 7, f"text {i}") for i in range(3000)]), folder, BYTES)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert token_files.part_starts(spark, folder).count() > 2
    rows = sorted((r.start, r.n_tokens, r.doc_id) for r in token_files.file_digests(spark, folder).collect())
    assert len(rows) == 3000 and all(a[0] + a[1] == b[0] for a, b in zip(rows, rows[1:]))
    assert [r[2] for r in rows] == [None] * 1500 + [7] * 1500


def test_no_documents_give_no_ids(spark, documents, tmp_path):
    token_files.write_token_files(documents([]), str(tmp_path / "none"), BYTES)
    assert token_files.file_digests(spark, str(tmp_path / "none")).count() == 0


# -- alignment --------------------------------------------------------------------------------------------------------


def aligned(rows) -> list[tuple]:
    a_side, b_side = library(special=False), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    symbols = byte_bpe.symbol_bytes()

    def of_a(i):
        return bytes(symbols[c] for c in a_side.id_to_token(i))

    def of_b(i):
        piece = b_side.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b_side.is_byte(i) else piece.replace("▁", " ").encode()

    count, found = collections.Counter(), []
    for doc_id, text in rows:
        a, b = a_side.encode(" " + text, add_special_tokens=False).ids if text else [], b_side.encode(text or "")
        if not text or b"".join(map(of_b, b)) != (" " + text).encode():
            found.append((doc_id, [], [], [], []))
            continue
        a_ends, b_ends = (np.cumsum([len(of(i)) for i in ids]).tolist() for of, ids in ((of_a, a), (of_b, b)))
        cuts, groups, i, j = sorted(set(a_ends) & set(b_ends)), [], 0, 0
        for cut in cuts:
            i2, j2 = a_ends.index(cut, i) + 1, b_ends.index(cut, j) + 1
            groups.append((a[i:i2], b[j:j2]))
            i, j = i2, j2
        links = [(g[-1], h[-1]) for g, h in groups]
        count.update(links)
        found.append((doc_id, a, b, groups, links))
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    out = []
    for doc_id, a, b, groups, links in found:
        text = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((
            doc_id, len(a), len(b), len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        ))
    return out


@pytest.mark.parametrize("block", [2_000_000, 10])
def test_alignment_equals_brute_force(spark, documents, monkeypatch, block):
    monkeypatch.setattr(alignment, "BLOCK_LINKS", block)
    rows = [r if r[0] != 7 else (7, LONG[:3000]) for r in ODD] + [(None, "the the them the. théâtre")]
    found = [tuple(r) for r in alignment.alignment_digests(documents(rows), BYTES, PIECES).collect()]
    assert sorted(found, key=repr) == sorted(aligned(rows), key=repr)
    assert sum(r[1] == 0 for r in found) == 3  # null, empty, and the text whose pieces spell it otherwise


def test_groups_are_given_as_ids(spark, documents):
    row = alignment.aligned_groups(documents([(1, "tab\tx  y   "), (2, None)]), BYTES, PIECES).orderBy("doc_id").collect()
    assert [(g.a, g.b) for g in row[0].groups][-1] == ([220, 220, 220], [2287]) and row[1].groups == []


def test_no_documents_are_aligned_to_no_rows(spark, documents):
    assert alignment.alignment_digests(documents([]), BYTES, PIECES).count() == 0


def test_doubling_finds_the_groups_of_random_ends():
    rnd = random.Random(3)
    for _ in range(200):
        size = rnd.randrange(1, 60)
        a, b = (np.array(sorted({*rnd.sample(range(1, size + 1), rnd.randrange(0, size)), size})) for _ in range(2))
        ends_a, ends_b = alignment.groups(a, b)
        assert a[ends_a - 1].tolist() == b[ends_b - 1].tolist() == sorted(set(a.tolist()) & set(b.tolist()))
