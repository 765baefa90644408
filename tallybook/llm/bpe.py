"""BPE encoding and decoding with shared word prefixes.

A token sequence is the BPE encoding of a word exactly if every two neighbours are: merging the two alone leaves both.
So each prefix of a word has one *last token*: the one that ends there, is its own encoding and gets on with the last
token of the prefix before it. A word's encoding is read off by walking back from its end, last token by last token.

Each batch of whole texts goes through four steps inside its task; nothing is shuffled:

1. normalise and split the texts as the vocabulary file says; collect the distinct words not seen before;
2. insert them into a trie, in sorted order, as the path to each word shares its nodes with the word before;
3. going down depth first, give every node its last token, once for all words that share the prefix;
4. read off the encodings and look every word of every text up.

The last symbol of a word carries the end mark and so is an edge of its own. Words seen are kept for later batches and
tasks, the latest ``KNOWN`` at most. That bounds memory and changes no result.
"""

import gc
import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.llm.common import held, ship

KNOWN = 200_000
# Texts whose new words share a trie; a batch of very long texts is cut by Spark's limit on bytes.
BATCH_ROWS = 1024


class Vocabulary:
    """Merges and tokens of a ``tokenizers`` file with word-end marks, byte symbols and a split pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.ids = model["vocab"]
        self.made = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.made[left, right] = rank
        # How each token comes about; tokens that are not made are single symbols.
        self.halves = {left + right: (left, right) for left, right in self.made}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        self.at_special = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.latin = _latin_pattern(split["pattern"]["Regex"])
        self.symbols = _byte_symbols()
        self.agreed: dict[tuple[str, str], bool] = {}

    def check(self) -> None:
        """Raise unless every token that is made is its own encoding, on which reading off words relies."""
        wrong = [a + b for a, b in self.made if self.agree(a, b)]
        if wrong:
            raise ValueError(f"tokens that merges do not reach: {wrong[:5]}")

    def words(self, text: str) -> list[str]:
        """Words and special tokens, in order."""
        if self.at_special is None or "<" not in text:
            return self._split(text)
        out = []
        for part in self.at_special.split(text):
            if part in self.special:
                out.append(part)
            elif part:
                out += self._split(part)
        return out

    def _split(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.pieces.findall(_lower(unicodedata.normalize("NFC", text)))
        # Latin-1 texts are their own normal form.
        return self.latin.findall(text.lower())

    def spelled(self, word: str) -> str:
        return word.encode("utf-8").decode("latin-1").translate(self.symbols)

    def agree(self, first: str, second: str) -> bool:
        """Whether merging the two tokens together leaves both as they are."""
        known = self.agreed.get((first, second))
        if known is None:
            if len(self.agreed) > 150_000:
                self.agreed.clear()
            known = self.agreed[first, second] = self._leaves_apart(first, second)
        return known

    def _leaves_apart(self, first: str, second: str) -> bool:
        # Take the later of the two border merges apart, and look each time whether the border would have closed sooner.
        bound_l = bound_r = len(self.made)
        while True:
            rank = self.made.get((first, second))
            # A merge at the border comes before an equal one to its right, and after one to its left.
            if rank is not None and rank < bound_l and rank <= bound_r:
                return False
            left, right = self.halves.get(first), self.halves.get(second)
            if left is None and right is None:
                return True
            rank_l = self.made[left] if left else -1
            rank_r = self.made[right] if right else -1
            if rank_l > rank_r:
                first, bound_l = left[1], rank_l
                bound_r = min(bound_r, rank_l)
            else:
                second, bound_r = right[0], rank_r
                bound_l = min(bound_l, rank_r + 1)


def _lower(text: str) -> str:
    # Letter by letter: a final sigma is not told apart.
    return (text.replace("Σ", "σ") if "Σ" in text else text).lower()


def _latin_pattern(pattern: str) -> re.Pattern:
    """The same pattern for texts of Latin-1, its classes written out for the faster standard module."""
    chars = [chr(i) for i in range(256)]
    for name, find in ((r"\p{L}", r"\p{L}"), (r"\p{N}", r"\p{N}"), (r"\s", r"\p{White_Space}")):
        inside = "".join(f"\\x{ord(c):02x}" for c in chars if regex.match(find, c))
        pattern = pattern.replace(name, inside)
    return re.compile(pattern)


def _byte_symbols() -> dict[int, str]:
    """The printable stand-in of every byte: printable Latin-1 as it is, the others from U+0100 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


class PrefixTrie:
    """The trie of some words with the last token of every prefix. Node 0 is the empty prefix."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        # By the last three symbols of a token (with the end mark, if any): the lengths of longer ones, falling.
        lengths: dict[str, set[int]] = {}
        for token in vocabulary.ids:
            body = token.removesuffix(vocabulary.end) if token.endswith(vocabulary.end) else token
            if len(body) > 3:
                lengths.setdefault(body[-3:] + token[len(body) :], set()).add(len(body))
        self.lengths = {k: tuple(sorted(x, reverse=True)) for k, x in lengths.items()}

    def encode(self, words: list[str]) -> dict[str, list[str]]:
        """Tokens of each distinct word."""
        v, ids, agreed, agree = self.v, self.v.ids, self.v.agreed, self.v.agree
        longer, short = self.lengths, (3, 2, 1)
        last, start = [""], [0]  # of each node: its last token, and the node where that begins
        path, before, out = [0], "", {}
        for text, word in sorted([(v.spelled(w), w) for w in words]):
            # Nodes of the prefix shared with the word before; its last symbol was a marked edge and is not shared.
            shared, end = 0, len(text)
            most = min(len(before), end) - 1
            while shared < most and text[shared] == before[shared]:
                shared += 1
            del path[shared + 1 :]
            for i in range(shared + 1, end + 1):
                mark = v.end if i == end else ""
                for n in (*longer.get(text[i - 3 : i] + mark, ()), *short) if i > 3 else short:
                    if n > i:
                        continue
                    token = text[i - n : i] + mark
                    if token in ids:
                        if n == i:
                            break
                        pair = (last[path[i - n]], token)
                        fits = agreed.get(pair)
                        if agree(*pair) if fits is None else fits:
                            break
                else:
                    raise ValueError(f"no token for {text[i - 1 : i]!r}")
                last.append(token)
                start.append(path[i - n])
                path.append(len(last) - 1)
            before, node, tokens = text, path[-1], []
            while node:
                tokens.append(last[node])
                node = start[node]
            tokens.reverse()
            out[word] = tokens
        return out


class Encoder:
    """Whole texts to ids and back, with the words seen so far."""

    def __init__(self, path: str, known: int = KNOWN):
        self.v, self.limit = Vocabulary(path), known
        self.trie = PrefixTrie(self.v)
        # Word -> its ids and its tokens, both joined by one space: of late, and before that.
        self.known: dict[str, tuple[str, str]] = {}
        self.before: dict[str, tuple[str, str]] = {}

    def learn(self, words: set[str]) -> None:
        """Make ``known`` hold all these words."""
        if len(self.known) > self.limit // 2:
            self.before, self.known = self.known, {}
        new = []
        for word in words:
            if word not in self.known:
                if word in self.before:
                    self.known[word] = self.before[word]
                else:
                    new.append(word)
        ids = self.v.ids
        for special in self.v.special.keys() & set(new):
            new.remove(special)
            self.known[special] = (str(self.v.special[special]), special)
        for word, tokens in self.trie.encode(new).items():
            self.known[word] = (" ".join([str(ids[t]) for t in tokens]), " ".join(tokens))

    def encode(self, text: str) -> list[int]:
        words = self.v.words(text)
        self.learn(set(words))
        return [int(i) for w in words for i in self.known[w][0].split(" ")]

    def decode(self, ids) -> str:
        """Tokens joined by one space, as the file names no decoder."""
        return " ".join([self.v.names[i] for i in ids])

    def digests(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """Number of tokens, SHA-256 of the ids joined by spaces, SHA-256 of the decoded text."""
        split = [self.v.words(t) for t in texts]
        self.learn(set().union(*split))
        out, get = [], self.known.__getitem__
        for words in split:
            found = [get(w) for w in words]
            ids, decoded = " ".join([i for i, _ in found]), " ".join([t for _, t in found])
            out.append((ids.count(" ") + 1 if ids else 0, _sha256(ids), _sha256(decoded)))
        return out


def loaded(path: str) -> Encoder:
    """This Python worker's encoder; what it has learned serves its later tasks, until another operator's begin."""
    return held(("bpe", path), lambda: Encoder(path))


def _sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def encoded_digests(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs`` (doc_id, text, any other columns).

    ``vocabulary`` is the path of the file, the same on every machine. Null text counts as empty and has no tokens.
    Repeated rows are each encoded. An empty table gives no rows. Raises if the vocabulary has tokens that its own
    merges do not reach.
    """
    ship(docs.sparkSession)
    Vocabulary(vocabulary).check()

    def run(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = loaded(vocabulary)
        for texts in columns:
            found = []
            gc.disable()  # many small tuples and no cycles: searching them for cycles takes longer than the work
            for at in range(0, len(texts), BATCH_ROWS):
                found += encoder.digests(texts.iloc[at : at + BATCH_ROWS].tolist())
            gc.enable()
            yield pd.DataFrame(found, columns=["n_tokens", "ids_sha256", "decoded_sha256"])

    digests = F.pandas_udf(run, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    found = docs.select("doc_id", digests(F.coalesce("text", F.lit(""))).alias("_bpe"))
    return found.select("doc_id", "_bpe.n_tokens", "_bpe.ids_sha256", "_bpe.decoded_sha256")


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """``docs`` with ``ids`` (array of int) and ``decoded`` (string) for every row; columns of these names are replaced."""
    ship(docs.sparkSession)

    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = loaded(vocabulary)
        for texts in series:
            ids = [encoder.encode(t) for t in texts.fillna("")]
            yield pd.DataFrame({"ids": ids, "decoded": [encoder.decode(i) for i in ids]})

    both = F.pandas_udf(run, "ids array<int>, decoded string")
    return docs.withColumn("_bpe", both(F.col("text"))).withColumns(
        {"ids": F.col("_bpe.ids"), "decoded": F.col("_bpe.decoded")}
    ).drop("_bpe")
