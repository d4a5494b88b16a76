"""Byte-level BPE encoding and decoding by a prefix-sharing traversal of the trie of distinct words.

The state of a trie node is the last token of the encoding of its prefix. With merges in rank order, the encoding of a
prefix ends in token t exactly if t is a suffix of the prefix and the pair (state before t, t) never merges further;
the states of a shared prefix are therefore computed once for all words below it. The trie is walked depth first as the
sorted list of distinct new words: each word keeps the states of its common prefix with the word before it. A word's
tokens are read backwards from its last state. Encoded words are kept in a bounded cache in the Python worker.

Defined cases: null texts count as empty; an empty text has no tokens; the special token's string in a text becomes its
id, as the tokenizers library does; repeated rows are encoded each for itself; texts of any length are encoded whole.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField

from lattica.llm.common import append_columns, as_text

#: So many encoded words are kept by a Python worker (some 60 MB); then the cache starts anew.
CACHE = 250_000
#: Texts are encoded together up to so many characters.
GROUP_CHARS = 1_500_000
#: Beyond this code point the library's own splitter decides what is a letter, a number or white space.
COMMON = chr(0x530)

_LATIN = chr(0x180)


def _ranges(inside) -> str:
    """The characters before _LATIN that are inside a class, for a character set of re."""
    return "".join(re.escape(chr(c)) for c in range(ord(_LATIN)) if inside(chr(c)))


def _byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """One tokenizer file (byte-level BPE, merges in rank order)."""

    def __init__(self, definition: str):
        import public_tokenizers
        import regex
        from tokenizers import pre_tokenizers

        d = json.loads(definition)
        byte = _byte_of_char()
        raw = lambda s: bytes(byte[c] for c in s)
        vocab = d["model"]["vocab"]
        self.ids = {raw(t): i for t, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for t, i in self.ids.items():
            self.bytes[i] = t
        for t, i in self.special.items():
            self.bytes[i] = t.encode()
        self.left, self.right = list(range(size)), list(range(size))
        self.merged: dict[tuple[int, int], int] = {}
        for m in d["model"]["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            t = vocab[a + b]
            self.left[t], self.right[t] = vocab[a], vocab[b]
            self.merged[vocab[a], vocab[b]] = t
        order = [vocab["".join(m.split(" ") if isinstance(m, str) else m)] for m in d["model"]["merges"]]
        if order != sorted(order) or min(order, default=256) < 256:
            raise ValueError("token ids must follow the order of the merges")
        self.prefixes = {t[:k] for t in self.ids for k in range(len(t) + 1)}
        self.state_of, self.state_bytes, self.state_tokens = {b"": 0}, [b""], [[]]
        self.steps: dict[int, int] = {}
        self.valid: dict[int, bool] = {}
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.splitter = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.packed = [array("I", [i]).tobytes() for i in range(size)]
        self.lengths = list(map(len, self.bytes))
        self.words: dict[str, bytes] = {t: self.packed[i] for t, i in self.special.items()}  # ids of words
        letters, spaces, digits = (_ranges(re_.match) for re_ in map(regex.compile, (r"\p{L}", r"\s", r"\p{N}")))
        self.latin = re.compile(f" ?[{letters}]++|'(?:s|t|re|ve|m|ll|d)| ?[{digits}]++| ?[^{spaces}{letters}{digits}]++|[{spaces}]+(?![^{spaces}])|[{spaces}]+")

    def pair_stays(self, a: int, b: int) -> bool:
        """Whether tokens a, b side by side are the encoding of their bytes: no merge across their border comes earlier."""
        left, right, merged, limit = self.left, self.right, self.merged, 1 << 60
        while True:
            t = merged.get((a, b))
            if t is not None and t < limit:
                return False
            if a > b:
                limit, a = a, right[a]
                if a == limit:
                    limit, b = b + 1, left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, left[b]
                if b + 1 == limit:
                    limit, a = a, right[a]
                    if a == limit:
                        return True

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte: the longest suffix so far that begins a token, with the tokens it ends in."""
        text = self.state_bytes[state] + bytes([byte])
        while text not in self.prefixes:
            text = text[1:]
        new = self.state_of.get(text)
        if new is None:
            new = self.state_of[text] = len(self.state_bytes)
            self.state_bytes.append(text)
            ends = [(len(text) - k, self.ids[text[k:]]) for k in range(len(text)) if text[k:] in self.ids]
            self.state_tokens.append(ends)
        self.steps[state << 8 | byte] = new
        return new

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Encodings (packed ids) of distinct words in sorted order: the depth-first order of their trie."""
        step, steps, ends, valid, stays = self._step, self.steps.get, self.state_tokens, self.valid, self.pair_stays
        packed, length_of = self.packed, self.lengths
        last: list[int] = [-1]  # last[i]: last token of the current word's prefix of length i
        states: list[int] = [0]  # states[i]: which tokens that prefix ends in
        before, out = b"", []
        for w in words:
            n, k = min(len(before), len(w)), 0
            while k < n and before[k] == w[k]:
                k += 1
            del last[k + 1 :], states[k + 1 :]
            state = states[k]
            for i in range(k, len(w)):
                state = steps(state << 8 | w[i]) or step(state, w[i])
                for length, t in ends[state]:
                    if length > i:  # the prefix is a token
                        break
                    key = last[i + 1 - length] << 20 | t
                    fits = valid.get(key)
                    if fits is None:
                        fits = valid[key] = stays(last[i + 1 - length], t)
                    if fits:
                        break
                last.append(t)
                states.append(state)
            tokens, i = [], len(w)
            while i:
                t = last[i]
                tokens.append(packed[t])
                i -= length_of[t]
            tokens.reverse()
            out.append(b"".join(tokens))
            before = w
        if len(valid) > 400_000:
            valid.clear()
        return out

    def _split(self, text: str) -> list[str]:
        top = max(text, default="")
        if top < _LATIN:
            return self.latin.findall(text)
        if top < COMMON:
            return self.pattern.findall(text)
        return [text[a:b] for _, (a, b) in self.splitter.pre_tokenize_str(text)]

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        split: list[list[str]] = []
        fresh: set[str] = set()
        for text in texts:
            parts = self.cut.split(text) if self.cut else [text]
            words = self._split(text) if len(parts) == 1 else [w for k, p in enumerate(parts) for w in ([p] if k % 2 else self._split(p))]
            split.append(words)
            fresh.update(words)
        fresh -= self.words.keys()
        if len(self.words) + len(fresh) > CACHE:
            self.words.clear()
            self.words.update((t, self.packed[i]) for t, i in self.special.items())
            fresh = set().union(*split) - self.words.keys()
        raw = {w.encode(): w for w in fresh}
        order = sorted(raw)
        self.words.update(zip(map(raw.__getitem__, order), self.encode_words(order)))
        known = self.words.__getitem__
        return [b"".join(map(known, words)) for words in split]

    def decode(self, ids: bytes) -> str:
        """The text of ids; ill-formed UTF-8 becomes replacement characters."""
        return b"".join(map(self.bytes.__getitem__, array("I", ids))).decode("utf-8", "replace")


_CODECS: dict[str, Codec] = {}


def codec(definition: str) -> Codec:
    """The codec of a tokenizer file's content; one is kept in each Python worker, with its cache."""
    key = hashlib.sha256(definition.encode()).hexdigest()
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(definition)
    return _CODECS[key]


def groups(texts: list[str], limit: int = GROUP_CHARS):
    """Runs of texts of about so many characters."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


FIELDS = [
    StructField("n_tokens", LongType()),
    StructField("ids_sha256", StringType()),
    StructField("decoded_sha256", StringType()),
]


def encode(docs: DataFrame, tokenizer_file: str, text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """docs with token counts and digests of ids and of the decoded text; with_ids adds the ids themselves (token_ids)."""
    with open(tokenizer_file, encoding="utf-8") as f:
        definition = f.read()
    shared = docs.sparkSession.sparkContext.broadcast(definition)
    at = docs.columns.index(text_col)

    def make():
        c = codec(shared.value)

        def work(batch):
            n, a, b, every = [], [], [], []
            for run in groups(as_text(batch.column(at))):
                for ids in c.encode_many(run):
                    n.append(len(ids) // 4)
                    a.append(hashlib.sha256(ids).hexdigest())
                    b.append(hashlib.sha256(c.decode(ids).encode()).hexdigest())
                    if with_ids:
                        every.append(array("i", ids).tolist())
            out = [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
            return out + [pa.array(every, pa.list_(pa.int32()))] * with_ids

        return work

    more = [StructField("token_ids", ArrayType(IntegerType()))] if with_ids else []
    return append_columns(docs, FIELDS + more, make)
