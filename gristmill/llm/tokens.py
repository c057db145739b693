"""Token ids of whole texts by the tokenizers library, remembered by word.

A byte-level BPE of this kind never lets a token reach over the place before a
space that has a non-space on at least one side: its pre-tokeniser always
breaks there. So the ids of a text are those of its pieces between such
places, and the library has to see each distinct piece once. Texts with other
runs of white space go to the library whole.
"""

from __future__ import annotations

import os
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are encoded at a time.
AT_ONCE = 8 << 20
#: End-of-document id that the queries append.
END = 2


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def ragged(data: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs data[first : first + size], one after another."""
    ends = np.cumsum(size)
    return data[np.repeat(first - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """ids of texts as little-endian unsigned 32-bit bytes. Pieces that come again in one batch are remembered, `most` of them."""

    def __init__(self, path: str, most: int = 300_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.most = Tokenizer.from_file(path), most
        self.vocabulary = self.library.get_vocab_size()
        self.opens = np.zeros(self.vocabulary, bool)  # ids whose text starts with a space
        for token, k in self.library.get_vocab().items():
            self.opens[k] = token.startswith("\u0120")
        self.known, self.ids, self.size = pa.array([], pa.string()), np.zeros(0, "<u4"), np.zeros(0, np.int64)  # pieces, ids of a space and each piece in a row, how many

    def whole(self, text: str) -> bytes:
        return array("I", self.library.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        column = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())).cast(pa.string()).fill_null("")
        if not len(column):
            return []
        cut = pc.split_pattern(column, " ")
        off = cut.offsets.to_numpy().astype(np.int64)
        found = cut.values.dictionary_encode()
        names, at = found.dictionary, found.indices.to_numpy().astype(np.int64)
        empty = pc.equal(pc.binary_length(names), 0).to_numpy(zero_copy_only=False)
        odd = pc.not_equal(pc.utf8_rtrim_whitespace(names), names).to_numpy(zero_copy_only=False)
        old = pc.index_in(names, value_set=self.known).fill_null(-1).to_numpy()
        new = np.flatnonzero((old < 0) & ~odd & ~empty)
        learnt, sizes = self._learn(names.take(pa.array(new)))
        heads = at[off[:-1]]  # no space goes before them
        head_ids = [x.ids for x in self.library.encode_batch_fast(names.take(pa.array(heads)).to_pylist(), add_special_tokens=False)]
        head_sizes = np.array([len(x) for x in head_ids], np.int64)
        # the runs of ids: those known, those learnt, those of heads
        data = np.concatenate([self.ids, learnt, *(np.array(x, "<u4") for x in head_ids)])
        every = np.concatenate([self.size, sizes, head_sizes])
        first = np.cumsum(every) - every
        run = np.where(old < 0, 0, old).astype(np.int64)
        run[new] = len(self.size) + np.arange(len(new))
        none = np.concatenate([odd | empty, np.zeros(len(heads), bool)])
        bad = np.concatenate([odd | empty, odd[heads]])
        run = np.concatenate([run, len(self.size) + len(new) + np.arange(len(heads))])
        often = new[np.bincount(at, minlength=len(names))[new] > 1]
        at[off[:-1]] = len(names) + np.arange(len(heads))
        run, none = run[at], none[at]
        each = np.where(none, 0, every[run]) if len(every) else np.zeros(len(at), np.int64)
        ids = ragged(data, first[run], each).tobytes()
        bounds = 4 * np.concatenate([[0], np.cumsum(each)[off[1:] - 1]])
        out = [ids[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]
        for k in np.flatnonzero(np.logical_or.reduceat(bad[at], off[:-1])):
            out[k] = self.whole(column[int(k)].as_py())
        self._keep(names.take(pa.array(often)), learnt, np.searchsorted(new, often), sizes)
        return out

    def _learn(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Many pieces are one text to the library: each starts with the only id in it that opens with a space."""
        ids, size = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)]
        for k in range(0, len(pieces), 1 << 14):
            part = pieces[k : k + (1 << 14)].to_pylist()
            ids.append(np.array(self.library.encode_batch_fast([" " + " ".join(part)], add_special_tokens=False)[0].ids, "<u4"))
            size.append(np.diff(np.append(np.flatnonzero(self.opens[ids[-1]]), len(ids[-1]))))
            assert len(size[-1]) == len(part)
        return np.concatenate(ids), np.concatenate(size)

    def _keep(self, pieces: pa.Array, learnt: np.ndarray, which: np.ndarray, sizes: np.ndarray) -> None:
        if len(self.known) + len(pieces) > self.most:
            self.known, self.ids, self.size = self.known[:0], self.ids[:0], self.size[:0]
        self.known = pa.concat_arrays([self.known, pieces])
        self.ids = np.concatenate([self.ids, ragged(learnt, (np.cumsum(sizes) - sizes)[which], sizes[which])])
        self.size = np.concatenate([self.size, sizes[which]])


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each Python worker; what it remembers outlives the task."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def ids_of(data: bytes) -> np.ndarray:
    return np.frombuffer(data, "<u4")
