"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once per worker.

A text is cut where no pre-token of the tokenizer can cross; the ids of the pieces, joined, are the ids of the
text. The files of the tokenizers are parameters; nothing is trained here.
"""

from __future__ import annotations

import functools
import itertools
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from faultline.llm.common import PieceTable, per_text

#: White space besides space and line feed, in UTF-8: texts with any go to the library whole.
OTHER_SPACE = re.compile(rb"[\t\r\x0b\x0c\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: What any other white space than control characters begins with.
SPACE_LEADS = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
CONTROL_SPACE = b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: Marks a piece that no space precedes, and stands for a space inside it: bytes that UTF-8 never holds.
WHOLE, KEPT_SPACE = b"\xff", b"\xfe"
#: Words of Latin letters only, marked WHOLE or not: one pre-token, which the model takes without the steps before it.
LETTERS = re.compile(rb"\xff?(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
SMALL_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")
#: Signs that end a word's pre-token and form the next one.
SIGNS = b".,;:!?#$%&*|"
IS_SIGN = np.isin(np.arange(256), list(SIGNS))
#: Bytes of text whose distinct pieces are told apart together, and how many of these are looked up at a time.
TOGETHER, AT_ONCE = 32 << 20, 1 << 16


def byte_characters() -> dict[int, int]:
    """Byte value -> character of byte-level vocabularies: visible Latin-1 stands for itself, others follow from 256."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = itertools.count(256)
    return {b: b if b in shown else next(rest) for b in range(256)}


BYTE_CHARACTERS = byte_characters()


@functools.lru_cache(maxsize=4)
def library(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _encode(path: str, texts: list[str]) -> list[list[int]]:
    return [e.ids for e in library(path).encode_batch_fast(texts, add_special_tokens=False)]


class _Pieces:
    """Encodes unseen pieces: signs after a word apart from it, plain words by the model alone."""

    def __init__(self, path: str, plain: re.Pattern):
        self.path, self.plain = path, plain
        self.model = library(path).model
        self.tails: dict[bytes, list[int]] = {}

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        hard: list[int] = []
        done: dict[bytes, list[int]] = {}
        for i, piece in enumerate(pieces):
            stem = piece.rstrip(SIGNS)
            if not self.plain.fullmatch(stem):
                hard.append(i)
                continue
            ids = done.get(stem)
            if ids is None:
                word = stem.decode("latin-1").translate(BYTE_CHARACTERS)
                ids = done[stem] = [t.id for t in self.model.tokenize(word)]
            tail = piece[len(stem) :]
            out[i] = ids + self._tail(tail) if tail else ids
        for i, ids in zip(hard, _encode(self.path, [pieces[i].decode() for i in hard])):
            out[i] = ids
        return out

    def _tail(self, signs: bytes) -> list[int]:
        if signs not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[signs] = _encode(self.path, [signs.decode()])[0]
        return self.tails[signs]


class _Words:
    """Encodes unseen pieces of a byte-level tokenizer: plain words by the model alone, other pieces by the library."""

    def __init__(self, path: str):
        self.path, self.tokenize = path, library(path).model.tokenize
        self.space = chr(BYTE_CHARACTERS[0x20])

    def _text(self, piece: bytes) -> str:
        if piece[:1] == WHOLE:
            return piece[1:].replace(KEPT_SPACE, b" ").decode()
        return piece.decode() if piece[:1] == b"\n" else " " + piece.decode()

    def __call__(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        hard: list[int] = []
        tokenize, space = self.tokenize, self.space
        for i, piece in enumerate(pieces):
            if piece.isalpha():  # of A-Z and a-z, which stand for themselves
                out[i] = [t.id for t in tokenize(space + piece.decode())]
            elif LETTERS.fullmatch(piece):
                word = piece.lstrip(WHOLE).decode("latin-1").translate(BYTE_CHARACTERS)
                out[i] = [t.id for t in tokenize(word if piece[:1] == WHOLE else space + word)]
            else:
                hard.append(i)
        for i, ids in zip(hard, _encode(self.path, [self._text(pieces[i]) for i in hard])):
            out[i] = ids
        return out


def _cut(text: bytes, leads: list[bytes]) -> bytes:
    """`text` with a space wherever pre-tokens part: before and after each line feed too, where a WHOLE piece begins. With longer or other
    white space than single ones inside it, the text is one piece. `leads`: those of SPACE_LEADS to look for."""
    spaced = text.replace(b"\n", b" \n")
    longer = b"  " in spaced or b"\n " in spaced or spaced[:1] == b" " or spaced[-1:] in (b" ", b"\n")
    if longer or len(text.translate(None, CONTROL_SPACE)) < len(text) or (leads and OTHER_SPACE.search(text)):
        return text.replace(b" ", KEPT_SPACE)
    return spaced.replace(b"\n", b"\n " + WHOLE)


def _column(values: list[bytes]) -> pa.LargeBinaryArray:
    """The values as a column; pa.array takes many times as long over long ones."""
    ends = np.cumsum([0, *map(len, values)])
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(values), [None, pa.py_buffer(ends), pa.py_buffer(b"".join(values))])


def _values(column: pa.LargeBinaryArray, a: int, b: int) -> tuple[list[bytes], np.ndarray]:
    """The values from `a` up to `b`, and the last byte of each, of a column of at least one without nulls and empty values that is no
    slice; several times as fast as to_pylist."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64, b - a + 1, 8 * a)
    data = data.slice(ends[0], ends[-1] - ends[0]).to_pybytes()
    ends = ends - ends[0]
    at = ends.tolist()
    return [data[x:y] for x, y in zip(at, at[1:])], np.frombuffer(data, np.uint8)[ends[1:] - 1]


class ByteLevelIds:
    """Ids under a byte-level tokenizer whose pre-tokens take one leading space.

    Single spaces and line feeds begin a pre-token wherever the white space is one character long, so the text is
    cut there. A text with longer or other white space is encoded whole. The pieces of many texts are told apart by Arrow, so each
    distinct one is looked up once, a word and the signs after it apart.
    """

    def __init__(self, path: str):
        self.table = PieceTable(_Words(path))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each text has."""
        runs = list(self.runs([texts]))
        return runs[0] if runs else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def runs(self, lists):
        """Ids of all texts of each list in order, and how many each text has; the pieces of the lists are looked up together."""
        held, size = [], 0
        for texts in lists:
            if texts:
                held.append(self._pieces(texts))
                size += sum(map(len, texts))
            if size >= TOGETHER:
                yield from self._coded(held)
                held, size = [], 0
        if held:
            yield from self._coded(held)

    def _pieces(self, texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of all texts, and how many each text has."""
        together = b"\n".join(texts)
        leads = [x for x in SPACE_LEADS if x in together]
        cut = pc.split_pattern(_column([WHOLE + _cut(t, leads) for t in texts]), " ")
        return cut.flatten().dictionary_encode(), cut.value_lengths().to_numpy()

    def _coded(self, held: list[tuple[pa.DictionaryArray, np.ndarray]]):
        runs = pa.chunked_array([pieces for pieces, _ in held]).unify_dictionaries().chunks
        distinct = runs[0].dictionary
        each = pa.concat_arrays([self._ids(*_values(distinct, a, min(a + AT_ONCE, len(distinct)))) for a in range(0, len(distinct), AT_ONCE)])
        for run, (_, counts) in zip(runs, held):
            coded = each.take(run.indices)
            ends = coded.offsets.to_numpy()[np.cumsum(counts)]
            yield coded.flatten().to_numpy(), np.diff(ends, prepend=0)

    def _ids(self, pieces: list[bytes], last: np.ndarray) -> pa.LargeListArray:
        """The ids of each piece. `last`: the last byte of each; signs at the end are looked up apart."""
        n, pairs, tails = len(pieces), [], []
        for i in np.flatnonzero(IS_SIGN[last]).tolist():
            piece = pieces[i]
            stem = piece.rstrip(SIGNS)
            if stem.isalpha() or LETTERS.fullmatch(stem):
                pieces[i] = stem
                pairs.append(i)
                tails.append(WHOLE + piece[len(stem) :])
        ids, sizes = self.table(pieces + tails)
        parts = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(ids))
        order = np.argsort(np.concatenate([np.arange(n), np.array(pairs, np.int64)]), kind="stable")
        whole = sizes[:n].copy()
        whole[pairs] += sizes[n:]
        return pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(whole)]), parts.take(pa.array(order)).flatten())


class SpacedIds:
    """Ids under a tokenizer that drops white space, ignores case and never joins what white space parts."""

    def __init__(self, path: str):
        self.table = PieceTable(_Pieces(path, SMALL_LETTERS))

    def __call__(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in order, and how many each text has."""
        pieces: list[bytes] = []
        counts: list[int] = []
        for text in texts:
            own = (text if b"<|" in text else text.lower()).split()
            pieces += own
            counts.append(len(own))
        ids, sizes = self.table(pieces)
        return ids, per_text(sizes, counts)


@functools.lru_cache(maxsize=2)
def byte_level(path: str) -> ByteLevelIds:
    return ByteLevelIds(path)


@functools.lru_cache(maxsize=2)
def spaced(path: str) -> SpacedIds:
    return SpacedIds(path)
