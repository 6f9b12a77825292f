"""BPE encoding of distinct words by one depth-first walk over a trie of their prefixes, and decoding.

Of a word's prefix only the last token of its encoding need be known: the rest is the encoding of the prefix before
that token, and two neighbouring tokens stay apart exactly if no merge joins them across their border before either
is used up. So the walk keeps one last token for each prefix on its path, and words that share a prefix share
its work. A word's last symbol is of another kind (it carries the end-of-word mark), hence a leaf.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import unicodedata

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from faultline.llm.common import PieceTable, chunks, key_type, per_text, texts_of, utf8
from faultline.llm.tokens import BYTE_CHARACTERS

#: A pair that no merge uses up.
NEVER = 1 << 60
#: Pairs of tokens, and pre-tokens, that are remembered from call to call.
REMEMBERED = 300_000
SMALL = re.compile(rb"[a-z]+")


class TrieBpe:
    """Encoder for a tokenizer file: Unicode NFC, white space and case as its normalizer has them, a split pattern whose matches
    are kept, byte-level symbols, and an end-of-word mark on the last symbol."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.mark = model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.split = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        vocab = model["vocab"]
        self.names = {i: t for t, i in (vocab | self.special).items()}
        self.inner = {t: i for t, i in vocab.items() if not t.endswith(self.mark)}
        self.final = {t[: -len(self.mark)]: i for t, i in vocab.items() if t.endswith(self.mark)}
        self.length = {i: len(t) for t, i in self.inner.items()} | {i: len(t) for t, i in self.final.items()}
        self.rank, self.parts, self.made = {}, {}, {}
        for r, merge in enumerate(model["merges"]):
            left, right = (vocab[t] for t in (merge if isinstance(merge, list) else merge.split(" ")))
            whole = vocab[self.names[left] + self.names[right]]
            self.rank[(left, right)] = r
            if whole not in self.made:
                self.made[whole], self.parts[whole] = r, (left, right)
        self.begun = {t[:k] for t in (*self.inner, *self.final) for k in range(1, len(t) + 1)}
        self.apart: dict[int, bool] = {}
        self.known: dict[str, list[int]] = {}
        self.table = PieceTable(self._encode_words)

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether the encodings [left] and [right] side by side are an encoding: no merge joins a part that ends `left`
        with a part that begins `right` while both are there."""
        key = left << 20 | right
        known = self.apart.get(key)
        if known is not None:
            return known
        a, b, a_until, b_until = left, right, NEVER, NEVER
        while True:
            rank = self.rank.get((a, b), NEVER)
            if rank < a_until and rank <= b_until and rank < NEVER:
                verdict = False
                break
            a_made, b_made = self.made.get(a, -1), self.made.get(b, -1)
            if a_made < 0 and b_made < 0:
                verdict = True
                break
            if a_made > b_made:  # undo the later merge
                a_until, a = a_made, self.parts[a][1]
            else:
                b_until, b = b_made, self.parts[b][0]
        if len(self.apart) >= REMEMBERED:
            self.apart.clear()
        self.apart[key] = verdict
        return verdict

    def _last(self, prefix: str, start: int, depth: int, last: list[int], vocab: dict[str, int]) -> int:
        """The last token of the encoding of `prefix`, given those of all shorter prefixes; it begins at `start` or after."""
        for start in range(start, depth):
            token = vocab.get(prefix[start:])
            if token is not None and (self._stay_apart(last[start], token) if start else self._whole(token)):
                return token
        raise ValueError(f"no token ends {prefix!r}: the vocabulary lacks a byte")

    def _whole(self, token: int) -> bool:
        """Whether the token's own characters are encoded as this one token: its parts, side by side, are joined by its merge first."""
        parts = self.parts.get(token)
        if parts is None:
            return True
        left, right = parts
        return self._stay_apart_but(left, right, self.made[token]) and self._whole(left) and self._whole(right)

    @functools.lru_cache(maxsize=200_000)  # noqa: B019  one encoder lives as long as its worker
    def _stay_apart_but(self, left: int, right: int, final: int) -> bool:
        a, b, a_until, b_until = left, right, NEVER, NEVER
        while True:
            rank = self.rank.get((a, b), NEVER)
            if rank != final and rank < a_until and rank <= b_until and rank < NEVER:
                return False
            a_made, b_made = self.made.get(a, -1), self.made.get(b, -1)
            if a_made < 0 and b_made < 0:
                return True
            if a_made > b_made:
                a_until, a = a_made, self.parts[a][1]
            else:
                b_until, b = b_made, self.parts[b][0]

    def encode_distinct(self, words: list[str]) -> dict[str, list[int]]:
        """Ids of pre-tokens in byte-level characters, each without the end-of-word mark."""
        root: dict = {}
        for word in words:
            node = root
            for c in word[:-1]:
                node = node.setdefault(c, {})
            node.setdefault("", []).append(word)
        out: dict[str, list[int]] = {}
        last = [-1] * (2 + max(map(len, words), default=0))
        stack = [(root, "", 0)]
        while stack:  # a child is visited before any other branch overwrites the path above it
            node, prefix, start = stack.pop()
            depth = len(prefix)
            if depth:
                while prefix[start:] not in self.begun:  # no token that ends here or later begins before
                    start += 1
                last[depth] = self._last(prefix, start, depth, last, self.inner)
            for word in node.get("", ()):
                token, end, ids = self._last(word, start, depth + 1, last, self.final), depth + 1, []
                while True:
                    ids.append(token)
                    end -= self.length[token]
                    if end == 0:
                        break
                    token = last[end]
                out[word] = ids[::-1]
            stack.extend((child, prefix + c, start) for c, child in node.items() if c)
        return out

    def _pretokens(self, word: bytes):
        """A word's pre-tokens in byte-level characters; a special token's string stands for its id."""
        if SMALL.fullmatch(word):
            return [word.decode()]
        out: list = []
        for k, part in enumerate(self.specials.split(word.decode())):
            if k % 2:
                out.append(self.special[part])
            else:
                text = unicodedata.normalize("NFC", part)
                text = text.lower() if text.isascii() else "".join(c.lower() for c in text)
                out += [p.encode().decode("latin-1").translate(BYTE_CHARACTERS) for p in self.split.findall(text)]
        return out

    def _encode_words(self, words: list[bytes]) -> list[list[int]]:
        split = [self._pretokens(w) for w in words]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        known.update(self.encode_distinct(list({p for ps in split for p in ps if isinstance(p, str) and p not in known})))
        return [known[ps[0]] if len(ps) == 1 and isinstance(ps[0], str) else list(itertools.chain.from_iterable(known[p] if isinstance(p, str) else [p] for p in ps)) for ps in split]

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each text has."""
        words: list[bytes] = []
        counts: list[int] = []
        for text in texts:
            own = (text if b"<|" in text else text.lower()).split()
            words += own
            counts.append(len(own))
        ids, sizes = self.table(words)
        return ids, per_text(sizes, counts)

    def decode(self, ids: list[int]) -> str:
        """The text of ids as the tokenizer's library gives it without a decoder: the tokens' strings, spaces between."""
        return " ".join(map(self.names.__getitem__, ids))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> TrieBpe:
    return TrieBpe(path)


def encode_decode(docs: DataFrame, tokenizer: str, with_output: bool = True) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids, decoded]) of every whole text; a null text is empty, with no
    ids and an empty decoded text. Rows are worked on one by one, repeated ones too."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", *(["ids", "decoded"] if with_output else [])]

    def run(batches):
        bpe = encoder(tokenizer)
        for batch in batches:
            texts, out = utf8(batch.column("text")), []
            for a, b in chunks(texts):
                ids, sizes = bpe.encode(texts[a:b])
                raw, at = ids.astype("<u4").tobytes(), 0
                for n in sizes.tolist():
                    decoded = bpe.decode(ids[at : at + n].tolist())
                    row = (n, hashlib.sha256(raw[4 * at : 4 * (at + n)]).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    out.append(row + ((ids[at : at + n], decoded) if with_output else ()))
                    at += n
            columns = [list(c) for c in zip(*out)] or [[] for _ in names[1:]]
            types = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))], names)

    plain = texts_of(docs)
    return plain.mapInArrow(run, f"doc_id {key_type(plain)}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_output)
