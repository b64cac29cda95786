"""Whole-text tokenisation with the `tokenizers` library and a word memo.

Both public vocabularies cut a text at a single space between two non-blank
characters before any merge is tried, so the ids of a text are the ids of its
space-separated pieces one after another.  Arrow cuts a batch of texts into pieces
and finds the distinct ones; their ids are kept in a bounded memo, and only new
pieces reach the library, many in one call.  Texts in which a piece is empty or
touches other white space (two blanks in a row, a blank beside a line end) are
encoded in one call, unsplit.

Ids travel as little-endian unsigned 32-bit numbers.
"""

from __future__ import annotations

import os
import string
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Most pieces that a worker remembers; about 260 bytes each.
MEMO_PIECES = 600_000
#: Pieces that are joined for one call of the library.
JOINED = 256
#: Punctuation that both vocabularies cut off after an ASCII letter or digit; not the
#: apostrophe, which may belong to the letters after it.
TAIL = "".join(c for c in string.punctuation if c != "'")
TAILED = "[0-9A-Za-z][" + "".join("\\" + c for c in TAIL) + "]+$"
#: Words of letters below U+0100 only.
LETTERS = "^[A-Za-zªµºÀ-ÖØ-öø-ÿ]+$"

_MEMOS: dict[str, "PieceMemo"] = {}


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _listed(a: pa.Array) -> list:
    """A list of Python values; by way of numpy, which is many times faster than to_pylist()."""
    return a.to_numpy(zero_copy_only=False).tolist()


class PieceMemo:
    """Ids of texts under one `tokenizers` vocabulary file.

    `spaced` says whether a blank belongs to the piece that follows it (byte
    level vocabularies) or is dropped (word-end vocabularies).
    """

    def __init__(self, path: str, spaced: bool, limit: int = MEMO_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.spaced, self.limit = spaced, limit
        #: pieces used lately, and those of the time before
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        # tokens that begin (spaced) or end a piece of letters
        names = [self.tok.id_to_token(i) or "" for i in range(self.tok.get_vocab_size())]
        self.border = np.array([n.startswith("Ġ") if spaced else n.endswith("</w>") for n in names], bool)

    def _encode(self, texts: list[str]) -> list[bytes]:
        if not texts:
            return []
        fast = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        return [packed(e.ids) for e in fast(texts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of words that hold only letters below U+0100: joined by blanks they are
        one token run each, told apart by the tokens that begin or end a word."""
        lead, groups = " " if self.spaced else "", [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        fast = getattr(self.tok, "encode_batch_fast", self.tok.encode_batch)
        out: list[bytes] = []
        for group, e in zip(groups, fast([lead + " ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            marks = np.flatnonzero(self.border[ids])
            if len(marks) != len(group):  # not expected; each word by itself then
                out += self._encode([lead + w for w in group])
                continue
            ends = ([*marks[1:].tolist(), len(ids)]) if self.spaced else (marks + 1).tolist()
            raw, last = ids.tobytes(), 0
            for n in ends:
                out.append(raw[4 * last : 4 * n])
                last = n
        return out

    def _learn(self, names: list[str], plain: list[bool]) -> list[bytes]:
        """Ids of new bases; plain says which are words of letters."""
        lead = " " if self.spaced else ""
        words = self._letters([x for x, p in zip(names, plain, strict=True) if p])
        rest = self._encode([lead + x for x, p in zip(names, plain, strict=True) if not p])
        words, rest = iter(words), iter(rest)
        out = [next(words if p else rest) for p in plain]
        self.known.update(zip(names, out, strict=True))
        return out

    def _bases(self, bases: pa.Array) -> list[bytes]:
        """Ids of distinct bases, from the memo as far as it has them."""
        if len(self.known) > self.limit // 2:
            self.known, self.older, self.tails = {}, self.known, {}
        names = _listed(bases)
        found = list(map(self.known.get, names))
        for turn in ("older", "new"):
            missing = [i for i, ids in enumerate(found) if ids is None]
            if not missing:
                break
            keys = [names[i] for i in missing]
            if turn == "older":
                got = list(map(self.older.get, keys)) if self.older else []
                self.known.update((k, ids) for k, ids in zip(keys, got, strict=bool(got)) if ids is not None)
            else:
                plain = pc.match_substring_regex(bases.take(pa.array(missing, pa.int64())), LETTERS)
                got = self._learn(keys, _listed(plain))
            for i, ids in zip(missing, got, strict=bool(got)):
                found[i] = ids
        return found

    def _ids(self, pieces: pa.Array) -> list[bytes]:
        """Ids of distinct pieces. A tail of punctuation after an ASCII letter or digit is
        cut off by both vocabularies before merges, so base and tail are looked up by
        themselves, and pieces that differ in their tails share a base."""
        tailed = pc.and_not(pc.match_substring_regex(pieces, TAILED), pc.match_substring(pieces, "<|"))
        bare = pc.if_else(tailed, pc.ascii_rtrim(pieces, characters=TAIL), pieces)
        bases = bare.dictionary_encode()
        found = self._bases(bases.dictionary)
        out = list(map(found.__getitem__, _listed(bases.indices)))
        which = np.flatnonzero(tailed.to_numpy(zero_copy_only=False)).tolist()
        ends = [p[len(b) :] for p, b in zip(_listed(pieces.filter(tailed)), _listed(bare.filter(tailed)), strict=True)]
        new = list(set(ends).difference(self.tails))
        self.tails.update(zip(new, self._encode(new), strict=True))
        for i, t in zip(which, ends, strict=True):
            out[i] += self.tails[t]
        return out

    def flat(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after another and where each text ends; a null text
        counts as empty. `end` is an id to put after each text."""
        n = len(texts)
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if self.spaced:
            cut = pc.split_pattern(texts, " ")
        else:  # the vocabulary lowers case itself; special tokens are the exception
            cut = pc.ascii_split_whitespace(pc.if_else(pc.match_substring(texts, "<|"), texts, pc.ascii_lower(texts)))
        bounds = np.asarray(cut.offsets.to_numpy(), np.int64)
        bounds = bounds - bounds[0]
        words = cut.flatten().dictionary_encode()
        at, pieces = np.asarray(words.indices.to_numpy(zero_copy_only=False), np.int64), words.dictionary
        if self.spaced:
            odd = pc.or_(pc.not_equal(pc.utf8_trim_whitespace(words.dictionary), words.dictionary), pc.equal(words.dictionary, ""))
            found, at, bounds = self._spaced(texts, pieces, np.asarray(odd.to_numpy(zero_copy_only=False), bool), at, bounds)
        else:
            found = self._ids(pieces)
        if end is not None:
            at = np.insert(at, bounds[1:], len(found))
            bounds = bounds + np.arange(n + 1)
            found.append(packed([end]))
        sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
        ids = np.frombuffer(b"".join(found), "<u4")
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(ids, pa.uint32()))
        out = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False)
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[bounds[1:]]
        return out, ends

    def _spaced(self, texts: pa.Array, pieces: pa.Array, odd: np.ndarray, at: np.ndarray, bounds: np.ndarray) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """First pieces have no blank before them, and texts with odd pieces stay whole;
        both become entries of their own behind the pieces."""
        first, many = bounds[:-1], np.diff(bounds) > 1
        whole = many & (np.add.reduceat(odd[at], first) > 0) if len(first) else many
        inner = np.ones(len(at), bool)
        inner[first] = False
        inner &= np.repeat(~whole, np.diff(bounds))
        used = np.zeros(len(pieces), bool)
        used[at[inner]] = True
        found = [b""] * len(pieces)
        which = np.flatnonzero(used).tolist()
        for i, ids in zip(which, self._ids(pieces.filter(pa.array(used))), strict=True):
            found[i] = ids
        heads = _listed(pieces.take(pa.array(at[first])))
        singly = self._encode([texts[i].as_py() if w else h for i, (w, h) in enumerate(zip(whole.tolist(), heads, strict=True))])
        at = at.copy()
        at[first] = len(pieces) + np.arange(len(first))
        keep = np.repeat(~whole, np.diff(bounds))
        keep[first] = True
        return found + singly, at[keep], np.concatenate([[0], np.cumsum(np.where(whole, 1, np.diff(bounds)))])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as bytes; None counts as an empty text."""
        ids, ends = self.flat(pa.array(texts, pa.string()))
        raw, stops = ids.astype("<u4").tobytes(), [0, *(4 * ends).tolist()]
        return [raw[a:b] for a, b in zip(stops, stops[1:], strict=False)]


def memo(path: str, spaced: bool, limit: int = MEMO_PIECES) -> PieceMemo:
    """The worker's memo of a vocabulary, kept between tasks."""
    if path not in _MEMOS:
        _MEMOS[path] = PieceMemo(path, spaced, limit)
    return _MEMOS[path]
