"""SentencePiece encoding and decoding with segmentations sampled without replacement.

The pieces of a public model are given Zipf weights by their merge rank, so a text's
segmentations form a lattice with a normalised distribution (backward sums, exact).
Gumbel top-k without replacement draws k distinct segmentations: every set of
segmentations carries the perturbed log-probability of its best member, drawn from the
top down. Following the argmax child needs no more than its conditional probability,
and all its siblings at a position together are one node whose perturbed value is a
Gumbel at their summed probability, cut off at the parent's value. A best-first (A*)
search over those nodes pops the next best complete segmentation, and splits the node
it came from. The value of the best node left, kappa, gives each sample its inclusion
score 1 - exp(-exp(log_prob - kappa)), or 1 when nothing is left.

Pieces do not cross from a word into the blank before the next, nor (in a model like the
public one, which is looked through for that) from letters into what is no letter, so the
lattice of a text is the chain of its words' lattices; those are kept per worker, and all
words of a batch walk through them together. Draws are hashes of (seed, row key, sample, place),
so results depend on nothing but the row. Characters without a piece become bytes.

A null text counts as empty; an empty text has one segmentation, of no pieces. Texts
with fewer than k segmentations give all they have. Rows with equal keys and texts give
equal samples. Extra columns are ignored. Literal U+2581 decodes to a blank, as the
library's own decoder has it.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

MODEL = "piece_bpe_32k.model"
SAMPLES = 2
SEED = 17
#: log weight of a piece of merge rank r: -SLOPE * log(r + SHIFT)
SLOPE, SHIFT = 1.0, 10.0
BYTE_WEIGHT = -12.0
MEMO_WORDS = 300_000
#: The largest Gumbel that a number of uniform() gives, rounded up.
CEILING = 37.0
SPACE = "▁"
_WORD = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Kinds of the first bytes of UTF-8 characters: blanks, Latin letters (and two signs among them), others.
_KIND = np.full(256, 2, np.uint8)
_KIND[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", *range(0xC3, 0xC9)]] = 1
_KIND[0x20] = 0
#: Words whose lattices are made together, so that their arrays stay in the processor's caches.
TOGETHER = 8192


class Pieces:
    """Pieces of a SentencePiece model: weights, bytes for decoding, and prefixes."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.weight: dict[str, tuple[int, float]] = {}
        self.bytes = {}
        self.raw: list[bytes] = [b""] * n
        for i in range(n):
            p = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(p[3:-1], 16)] = i
                self.raw[i] = bytes([int(p[3:-1], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                rank = min(-sp.get_score(i), float(n))
                self.weight[p] = (i, -SLOPE * math.log(rank + SHIFT))
                self.raw[i] = p.replace(SPACE, " ").encode("utf-8")
        self.table = pa.array(self.raw, pa.binary())
        # where a cut falls depends on the two characters beside it, so a piece that is whole here is whole everywhere
        self.kind, names = _KIND, pa.array([p.replace(SPACE, " ") for p in self.weight], pa.string())
        if len(self.cut(names)[0]) > len(names):
            self.kind = np.minimum(_KIND, 1)  # cuts before blanks only
        self.trie()

    def trie(self) -> None:
        """The pieces as transitions (node * alphabet + character -> node) in sorted arrays."""
        chars = sorted({c for p in self.weight for c in p})
        self.alphabet = len(chars) + 1
        self.char_of = np.zeros(max(map(ord, chars)) + 2, np.int64)
        self.char_of[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        number = {"": 0}
        for p in self.weight:
            for k in range(1, len(p) + 1):
                number.setdefault(p[:k], len(number))
        keys = np.array([number[p[:-1]] * self.alphabet + self.char_of[ord(p[-1])] for p in number if p], np.int64)
        nodes = np.array([n for p, n in number.items() if p], np.int64)
        order = np.argsort(keys)
        self.keys, self.nodes = keys[order], nodes[order]
        self.piece_at = np.full(len(number), -1, np.int64)
        self.weight_at = np.zeros(len(number))
        for p, (i, w) in self.weight.items():
            self.piece_at[number[p]], self.weight_at[number[p]] = i, w

    def edges(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Edges over all words' characters: from, to, first id, weight, ids; places
        count the characters of all words before, and one end per word. An edge of
        several ids (a character as bytes) has first id -1 - character."""
        codes = np.frombuffer("\n".join([*words, ""]).encode("utf-32-le"), "<u4").astype(np.int64)  # a line end per word end
        codes[codes == 0x20] = ord(SPACE)
        inside = np.ones(len(codes), bool)
        inside[np.cumsum([len(w) + 1 for w in words]) - 1] = False
        char = np.where(codes < len(self.char_of), self.char_of[np.minimum(codes, len(self.char_of) - 1)], 0)
        char[~inside] = 0
        start = np.flatnonzero(inside)
        state, at, depth = np.zeros(len(start), np.int64), start, 0
        src, dst, own, weight = [], [], [], []
        alone = np.zeros(len(codes), bool)
        while len(at):
            key = state * self.alphabet + char[at + depth]
            k = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = (self.keys[k] == key) & (char[at + depth] > 0)
            at, state = at[ok], self.nodes[k[ok]]
            depth += 1
            piece = self.piece_at[state] >= 0
            src.append(at[piece])
            dst.append(at[piece] + depth)
            own.append(self.piece_at[state[piece]])
            weight.append(self.weight_at[state[piece]])
            if depth == 1:
                alone[at[piece]] = True
            on = at + depth < len(codes)
            at, state = at[on], state[on]
        rest = start[~alone[start]]
        n_bytes = 1 + (codes[rest] > 0x7F) + (codes[rest] > 0x7FF) + (codes[rest] > 0xFFFF)
        return np.concatenate([*src, rest]), np.concatenate([*dst, rest + 1]), np.concatenate([*own, -1 - codes[rest]]), np.concatenate([*weight, BYTE_WEIGHT * n_bytes])

    def cut(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """Words of all texts, which have blanks for SPACE, and how many words each text has."""
        n, base = len(texts), texts.offset
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[base : base + n + 1] if n else np.zeros(1, np.int32)
        body = texts.buffers()[2] if n else None
        raw = np.frombuffer(body, np.uint8)[: offsets[-1]] if body is not None and offsets[-1] else np.zeros(0, np.uint8)
        at = np.flatnonzero((raw & 0xC0) != 0x80)
        kind = self.kind[raw[at]]
        heads = np.ones(len(at), bool)
        heads[1:] = (kind[1:] != kind[:-1]) & (kind[:-1] != 0)
        begins = np.zeros(len(raw) + 1, bool)
        begins[at[heads]] = True
        begins[offsets] = True  # each text by itself
        begins[: offsets[0]] = False
        begins[len(raw)] = False
        starts = np.flatnonzero(begins).astype(np.int32)
        words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, np.int32(len(raw)))), pa.py_buffer(raw))
        return words, np.diff(np.searchsorted(starts, offsets))

    def bytes_of(self, ids: np.ndarray) -> bytes:
        """Bytes of ids, with the blank that encoding puts first."""
        got = self.table.take(pa.array(ids))
        return got.buffers()[2].to_pybytes() if len(ids) else b""

    def decode(self, ids: list[int]) -> str:
        """Text of ids, without the blank that encoding puts first."""
        raw = b"".join(map(self.raw.__getitem__, ids))
        return raw[1:].decode("utf-8", "replace") if raw[:1] == b" " else raw.decode("utf-8", "replace")


def normalised(text: str | None) -> str:
    return SPACE + text.replace(" ", SPACE) if text else ""


def ordered(*keys: np.ndarray) -> np.ndarray:
    """Order by the keys, the first above all. The last are lengths of pieces; no two
    rows are alike in all keys."""
    head, length = keys[0], keys[-1]
    if not len(head) or length.max() >= 32:
        return np.lexsort(keys[::-1])
    if len(keys) == 2:
        return np.argsort(head * 32 + length) if head.max() < 1 << 58 else np.lexsort(keys[::-1])
    if head.max() >= 1 << 27:
        return np.lexsort(keys[::-1])
    bits = (keys[1] + 0.0).astype("<f4").view("<u4").astype(np.int64)  # 31 bits in the order of numbers from zero up; no -0.0
    return np.argsort((head << 36) | (bits << 5) | length)


def blanked(texts: pa.Array) -> pa.StringArray:
    """The texts as normalised() has them, but with a blank for SPACE."""
    texts = pc.replace_substring(pc.fill_null(texts.cast(pa.string()), ""), SPACE, " ")
    return pc.if_else(pc.equal(texts, ""), texts, pc.binary_join_element_wise("", texts, " "))


class Lattices:
    """Word lattices in flat arrays: nodes name their edges, likeliest first."""

    def __init__(self, pieces: Pieces):
        self.pieces = pieces
        self.clear()

    def clear(self) -> None:
        self.at: dict[str, int] = {}  # word -> its first node
        self.size = {"node": 0, "edge": 0}
        self.first = np.zeros(1 << 16, np.int32)  # node -> first edge (-1: the end)
        self.to = np.zeros(1 << 17, np.int32)
        self.below = np.zeros(1 << 17, np.float32)  # probability of this edge and those before it
        self.lp = np.zeros(1 << 17, np.float32)
        self.own = np.zeros(1 << 17, np.int32)  # piece id, or -1 - character for one as bytes

    def ids_of(self, edges: np.ndarray) -> np.ndarray:
        ids = self.own[edges]
        odd = np.flatnonzero(ids < 0)
        if not len(odd):
            return ids
        raws = [[self.pieces.bytes[x] for x in chr(-1 - c).encode("utf-8")] for c in ids[odd].tolist()]
        n = np.ones(len(ids), np.int64)
        n[odd] = [len(r) for r in raws]
        at, out = np.cumsum(n) - n, np.repeat(ids, n)
        for k, r in zip(at[odd].tolist(), raws, strict=True):
            out[k : k + len(r)] = r
        return out

    def rest(self, edges: np.ndarray) -> np.ndarray:
        """Log of the other edges' probability."""
        with np.errstate(divide="ignore"):
            return np.log(-np.expm1(np.minimum(self.lp[edges].astype(np.float64), 0.0)))

    def _room(self, kind: str, names: tuple[str, ...], more: int) -> int:
        start = self.size[kind]
        self.size[kind] = start + more
        for n in names:
            a = getattr(self, n)
            if len(a) < start + more:
                setattr(self, n, np.concatenate([a, np.zeros(max(len(a) // 4, more), a.dtype)]))
        return start

    def add(self, words: list[str]) -> None:
        for i in range(0, len(words), TOGETHER):
            self._add(words[i : i + TOGETHER])

    def _add(self, words: list[str]) -> None:
        """Lattices of new words, their backward sums taken position by position together."""
        src, dst, own, lw = self.pieces.edges(words)
        sizes = np.array([len(w) + 1 for w in words], np.int64)
        count, ends = int(sizes.sum()), np.cumsum(sizes) - 1
        base = ends - sizes + 1
        left = np.repeat(ends, sizes) - np.arange(count)  # characters to the end
        order = ordered(left[src] * count + src, dst - src)
        src, dst, own, lw = src[order], dst[order], own[order], lw[order]
        beta = np.zeros(count)
        heads = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        level = left[src[heads]]
        cuts = np.concatenate([[0], np.flatnonzero(np.diff(level)) + 1, [len(heads)]])
        stops = np.append(heads, len(src))
        for k in range(len(cuts) - 1):
            h = heads[cuts[k] : cuts[k + 1]]
            a, b = h[0], stops[cuts[k + 1]]
            beta[src[h]] = np.logaddexp.reduceat(lw[a:b] + beta[dst[a:b]], h - a)
        lp = lw + beta[dst] - beta[src]
        order = ordered(src, -np.minimum(lp, 0.0), dst - src)
        src, dst, lp, own = src[order], dst[order], lp[order], own[order]
        p = np.exp(lp)
        total = np.cumsum(p)
        heads = np.flatnonzero(np.concatenate([[True], src[1:] != src[:-1]]))
        sizes = np.diff(np.append(heads, len(src)))
        before = np.repeat(total[heads] - p[heads], sizes)
        lp[heads[sizes == 1]] = 0.0
        node0 = self._room("node", ("first",), count)
        edge0 = self._room("edge", ("to", "below", "lp", "own"), len(src))
        self.first[node0 : node0 + count] = -1
        self.first[node0 + src[heads]] = edge0 + heads
        e = slice(edge0, edge0 + len(src))
        self.to[e], self.lp[e] = node0 + dst, lp
        self.below[e] = np.minimum(total - before, 1.0)
        tails = heads + sizes - 1
        self.below[edge0 + tails] = 2.0  # the last edge takes what rounding leaves
        self.own[e] = own
        self.at.update(zip(words, (node0 + base).tolist(), strict=True))

    def find(self, words: list[str]) -> np.ndarray:
        """First node of each of the distinct words."""
        fresh = [w for w in words if w not in self.at]
        if fresh and len(self.at) + len(fresh) > MEMO_WORDS:
            self.clear()
            fresh = words
        if fresh:
            self.add(fresh)
        return np.fromiter(map(self.at.__getitem__, words), np.int64, len(words))

    def starts(self, texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """First node of each word of all blanked() texts, and how many words each text has."""
        words, lengths = self.pieces.cut(texts)
        words = words.dictionary_encode()
        first = self.find(words.dictionary.to_numpy(zero_copy_only=False).tolist())
        return first[words.indices.to_numpy()], lengths


_A, _B, _ALL = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, (1 << 64) - 1


def seed_of(*parts: int) -> int:
    """A 64-bit hash of integers; mixed() continues it over arrays."""
    h = 0x243F6A8885A308D3
    for x in parts:
        h = (h ^ x) * _A & _ALL
        h = (h ^ h >> 31) * _B & _ALL
        h ^= h >> 29
    return h


def mixed(h: np.ndarray, x: np.ndarray) -> np.ndarray:
    h = (h ^ x.astype(np.uint64)) * np.uint64(_A)
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_B)
    return h ^ (h >> np.uint64(29))


def uniform(h: np.ndarray) -> np.ndarray:
    """The hash as a number in (0, 1)."""
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def chance(*parts: int) -> float:
    return ((seed_of(*parts) >> 11) + 0.5) / (1 << 53)


def walk(lat: Lattices, node: np.ndarray, seeds: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Random paths from the nodes to their words' ends: (edges in order of start, how many per start)."""
    n = len(node)
    edges, owners = [], []
    base = mixed(seeds, place)
    live = np.flatnonzero(lat.first[node] >= 0)
    at, turn = node[live].copy(), 0
    while len(live):
        u = uniform(mixed(base[live], np.array([turn])))
        e = lat.first[at].copy()
        more = np.flatnonzero(u >= lat.below[e])
        while len(more):
            e[more] += 1
            more = more[u[more] >= lat.below[e[more]]]
        edges.append(e)
        owners.append(live)
        at = lat.to[e].astype(np.int64)
        on = lat.first[at] >= 0
        live, at, turn = live[on], at[on], turn + 1
    if not edges:
        return np.zeros(0, np.int64), np.zeros(n, np.int64)
    edge, owner = np.concatenate(edges), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return edge[order], np.bincount(owner, minlength=n)


def truncated(location: np.ndarray, bound: float, u: np.ndarray) -> np.ndarray:
    """Gumbels at the locations, given that they are below the bound."""
    return -np.logaddexp(-bound, np.log(-np.log(u)) - location)


class Search:
    """The state of one text: paths found, and the best-first queue of sibling nodes."""

    def __init__(self, lat: Lattices, key: int, k: int):
        self.lat, self.key, self.k = lat, key, k
        self.paths: list[dict] = []
        self.next: tuple | None = None  # (value, path, position)

    def take(self, edges: np.ndarray, nodes: np.ndarray, words: np.ndarray, value: float, own: int) -> None:
        """A path popped with its value; positions before `own` share their siblings with an earlier path."""
        lp = self.lat.lp[edges].astype(np.float64)
        upto = np.cumsum(lp)
        self.paths.append({"edges": edges, "nodes": nodes, "words": words, "g": np.full(len(edges), -np.inf), "done": own, "value": value, "lp": float(upto[-1]) if len(edges) else 0.0, "before": upto - lp, "gone": {}})

    def _draw(self, turn: int) -> None:
        """Perturbed values of the next positions of a path. They are drawn only as far
        as they can matter: beyond, `before` and CEILING bound them."""
        p = self.paths[turn]
        a = p["done"]
        b = p["done"] = min(len(p["g"]), a + max(256, a))
        location = p["before"][a:b] + self.lat.rest(p["edges"][a:b])
        p["g"][a:b] = truncated(location, p["value"], uniform(mixed(np.array([seed_of(self.key, 1000 + turn)], np.uint64), np.arange(a, b))))

    def best(self) -> tuple[float, int, int]:
        while True:
            tops = [(float(p["g"][: p["done"]].max()) if p["done"] else -np.inf, i) for i, p in enumerate(self.paths)]
            value, i = max(tops, key=lambda x: (x[0], -x[1]))
            open_ = [k for k, p in enumerate(self.paths) if p["done"] < len(p["g"]) and p["before"][p["done"]] + CEILING > value]
            if not open_:
                return value, i, int(np.argmax(self.paths[i]["g"])) if value > -np.inf else -1
            for k in open_:
                self._draw(k)

    def branch(self) -> tuple[int, int, int, float] | None:
        """Pop the best node: (path, position, edge taken there, value)."""
        value, i, at = self.best()
        if at < 0:
            return None
        p, lat = self.paths[i], self.lat
        gone = p["gone"].setdefault(at, {int(p["edges"][at])})
        e = int(lat.first[p["nodes"][at]])
        left = []
        while True:
            if e not in gone:
                left.append(e)
            if lat.below[e] > 1.5:
                break
            e += 1
        logs = lat.lp[left].astype(np.float64)
        share = np.exp(logs - logs.max())
        u = chance(self.key, 2000 + len(self.paths), at)
        pick = min(int(np.searchsorted(np.cumsum(share) / share.sum(), u)), len(left) - 1)
        gone.add(left[pick])
        others = [x for k, x in enumerate(logs) if k != pick]
        if others:
            u = chance(self.key, 3000 + len(self.paths), at)
            p["g"][at] = truncated(np.array([p["before"][at] + np.logaddexp.reduce(others)]), value, np.array([u]))[0]
        else:
            p["g"][at] = -np.inf
        return i, at, left[pick], value


def sample(lat: Lattices, keys: list[int], texts: list[str | None] | pa.Array, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float, float]]]:
    """Per text its samples: (ids, log_prob, perturbed value, inclusion score), best first."""
    first, lengths = lat.starts(blanked(texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    seeds = lambda turn: np.array([seed_of(x, turn) for x in keys], np.uint64)
    place = np.arange(len(first)) - np.repeat(offsets[:-1], lengths)
    found = [Search(lat, x, k) for x in keys]

    def nodes_of(edges: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
        nodes = np.empty(len(edges), np.int64)
        nodes[1:] = lat.to[edges[:-1]]
        heads = np.cumsum(counts) - counts
        nodes[heads[counts > 0]] = starts[counts > 0]
        return nodes

    edges, counts = walk(lat, first, np.repeat(seeds(0), lengths), place)
    ends = np.concatenate([[0], np.cumsum(counts)])
    for i, s in enumerate(found):
        a, b = offsets[i], offsets[i + 1]
        own = edges[ends[a] : ends[b]]
        root = -math.log(-math.log(chance(s.key, 999)))
        s.take(own, nodes_of(own, first[a:b], counts[a:b]), np.repeat(np.arange(b - a), counts[a:b]), root, 0)
    live = list(range(len(found)))
    for turn in range(1, k):
        forks, starts, ks, ps, own_seeds = [], [], [], [], seeds(turn)
        for i in live:
            got = found[i].branch()
            if got is None:
                continue
            path = found[i].paths[got[0]]
            word = int(path["words"][got[1]])
            a, b = offsets[i] + word, offsets[i + 1]
            begin = first[a:b].copy()
            begin[0] = lat.to[got[2]]
            forks.append((i, *got, word))
            starts.append(begin)
            ks.append(np.full(b - a, own_seeds[i]))
            ps.append(place[a:b])
        live = [f[0] for f in forks]
        if not forks:
            break
        node = np.concatenate(starts)
        edges, counts = walk(lat, node, np.concatenate(ks), np.concatenate(ps))
        ends = np.concatenate([[0], np.cumsum(counts)])
        at = 0
        for (i, source, position, taken, value, word), begin in zip(forks, starts, strict=True):
            own = edges[ends[at] : ends[at + len(begin)]]
            c = counts[at : at + len(begin)]
            at += len(begin)
            path = found[i].paths[source]
            more = nodes_of(own, begin, c)
            whole = np.concatenate([path["edges"][:position], [taken], own])
            nodes = np.concatenate([path["nodes"][: position + 1], more])
            words = np.concatenate([path["words"][: position + 1], word + np.repeat(np.arange(len(begin)), c)])
            found[i].take(whole, nodes, words, value, position + 1)
    out = []
    for s in found:
        kappa = s.best()[0]
        rows = []
        for p in s.paths:
            kept = 1.0 if kappa == -np.inf else -math.expm1(-math.exp(min(p["lp"] - kappa, 700.0)))
            rows.append((lat.ids_of(p["edges"]), p["lp"], p["value"], kept))
        out.append(rows)
    return out


_LATTICES: dict[str, Lattices] = {}


def lattices(path: str) -> Lattices:
    if path not in _LATTICES:
        _LATTICES[path] = Lattices(Pieces(path))
    return _LATTICES[path]


SAMPLED = "doc_id long, sample int, n_pieces long, log_prob double, perturbed double, inclusion double, ids binary, round_trip boolean"
_KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.binary(), pa.bool_()]


def row_key(doc_id: int | None, seed: int) -> int:
    return xxhash.xxh3_64_intdigest(f"{seed}:{doc_id}")


def encoded(docs: DataFrame, k: int = SAMPLES, seed: int = SEED, model: str | None = None) -> DataFrame:
    """Sampled segmentations of documents (doc_id, text): a row per sample with its ids
    (uint32 bytes) and whether they decode to the text again."""
    path = model or tokens.vocabulary(MODEL)
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(path)
        for b in batches:
            ids, out = b.column(0).to_pylist(), []
            for doc_id, text, rows in zip(ids, blanked(b.column(1)), sample(lat, [row_key(i, seed) for i in ids], b.column(1), k), strict=True):
                plain = text.as_py().encode("utf-8")
                for turn, (own, lp, value, kept) in enumerate(rows, 1):
                    same = lat.pieces.bytes_of(own) == plain
                    out.append((doc_id, turn, len(own), lp, value, kept, own.astype("<u4").tobytes(), same))
            cols = list(zip(*out, strict=True)) or [[]] * len(_KINDS)
            yield pa.record_batch([pa.array(c, t) for c, t in zip(cols, _KINDS, strict=True)], names=[x.split()[0] for x in SAMPLED.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SAMPLED)


def decoded(rows: DataFrame, model: str | None = None) -> DataFrame:
    """rows (doc_id, sample, ids) with the text of their ids."""
    path = model or tokens.vocabulary(MODEL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = lattices(path).pieces
        for b in batches:
            texts = [pieces.decode(np.frombuffer(x, "<u4").tolist()) for x in b.column(2).to_pylist()]
            yield pa.record_batch([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "sample", "text"])

    return rows.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")


def op6_sampled_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sampled segmentations of every document, digested."""

    def crc(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sums = pa.array([zlib.crc32(x) for x in b.column(6).to_pylist()], pa.int64())
            yield pa.record_batch([*b.columns[:6], sums, b.column(7)], names=[*b.schema.names[:6], "ids_crc32", "round_trip"])

    ddl = SAMPLED.replace("ids binary", "ids_crc32 long")
    return encoded(common.documents(spark, sf_dir)).mapInArrow(crc, ddl)


QUERIES = {"op6_sampled_segmentation": op6_sampled_segmentation}
