"""Byte-pair merging over flat numpy arrays, for many words at once."""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa

SPACE = "▁"
NEVER = np.int32(2**31 - 1)
BARE = "\x01"


@dataclass
class Pairs:
    """Which two adjacent symbols merge: sorted keys ``left * base + right``, rank and result.

    ``spread`` marks results that can take part in a merge of a better rank than their own.
    Occurrences of such a merge are applied together only ``reach`` symbols apart, beyond
    which what follows from one can't touch another; the order of single merges then holds.
    ``shared`` marks ranks that several results share (runs of spaces): there the leftmost
    pair goes first whatever it gives, so a word that comes to such a rank is ended one merge
    at a time.
    """

    base: int
    keys: np.ndarray
    rank: np.ndarray
    result: np.ndarray
    spread: np.ndarray
    shared: np.ndarray
    reach: int

    @classmethod
    def build(cls, found: dict[tuple[int, int], tuple[int, int]], base: int, longest: int) -> Pairs:
        keys = np.array([a * base + b for a, b in found], dtype=np.int64)
        order = np.argsort(keys)
        rank, result = (np.array([v[i] for v in found.values()], dtype=np.int32)[order] for i in (0, 1))
        own = np.full(base, -1, dtype=np.int64)
        own[result] = rank
        spread = np.zeros(base, dtype=bool)
        for (a, b), (r, _) in found.items():
            for part in (a, b):
                if own[part] >= r:
                    spread[part] = True
        sole = np.full(rank.max() + 1, -1, dtype=np.int64)
        sole[rank] = result
        shared = np.zeros(len(sole), dtype=bool)
        shared[rank[sole[rank] != result]] = True
        return cls(base, keys[order], rank, result, spread, shared, 2 * longest + 2)

    def look(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NEVER where they don't merge) and result of each pair of symbols."""
        key = left * self.base + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.rank[at], NEVER), self.result[at]


def _one_by_one(sym: list[int], pairs: Pairs) -> list[int]:
    """End a word with a heap of its pairs, the best rank first and then the leftmost."""
    n = len(sym)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap: list[tuple[int, int, int, int]] = []

    def offer(at: list[int]) -> None:
        rank, _ = pairs.look(np.array([sym[i] for i in at]), np.array([sym[after[i]] for i in at]))
        for i, r in zip(at, rank.tolist(), strict=True):
            if r != NEVER:
                heapq.heappush(heap, (r, i, sym[i], sym[after[i]]))

    offer(list(range(n - 1)))
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if not alive[i] or j >= n or sym[i] != a or sym[j] != b:
            continue
        sym[i] = int(pairs.look(np.array([a]), np.array([b]))[1][0])
        alive[j], after[i] = False, after[j]
        if after[j] < n:
            before[after[j]] = i
        if near := [k for k in (before[i], i) if k >= 0 and after[k] < n]:
            offer(near)
    return [s for s, a in zip(sym, alive, strict=True) if a]


def _together(at: np.ndarray, word: np.ndarray, spread: np.ndarray, reach: int) -> np.ndarray:
    """Of positions with their word's least rank, those that merge in this round."""
    if len(at) < 2 or not ((word[1:] == word[:-1]).any()):
        return at
    first = np.r_[True, word[1:] != word[:-1]]
    chain = first | np.r_[True, np.diff(at) != 1]  # starts of runs of overlapping occurrences
    nth = np.arange(len(at)) - np.maximum.accumulate(np.where(chain, np.arange(len(at)), 0))
    take = nth % 2 == 0
    wary = np.zeros(word[-1] + 1, dtype=bool)
    wary[word[spread]] = True
    if (again := wary[word] & ~first).any():
        take &= ~again
        last = -1
        for i in np.flatnonzero(wary[word]).tolist():
            if first[i] or at[i] - last >= reach:
                take[i], last = True, at[i]
    return at[take]


def merge_rounds(symbols: np.ndarray, lengths: np.ndarray, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """Merge until no pair remains; the symbols of all words in order, and how many each has.

    A round finds each word's least pair rank, merges its leftmost occurrences in all words at
    once and closes the gaps.  Words without a pair leave the arrays.
    """
    n_words = len(lengths)
    sym, word = symbols.astype(np.int64), np.repeat(np.arange(n_words), lengths)
    done_sym, done_word = [], []
    rank, result = np.full(len(sym), NEVER, dtype=np.int32), np.zeros(len(sym), dtype=np.int32)
    if len(sym) > 1:
        rank[:-1], result[:-1] = pairs.look(sym[:-1], sym[1:])
        rank[:-1][word[:-1] != word[1:]] = NEVER
    while len(sym):
        starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
        least = np.minimum.reduceat(rank, starts)
        sizes = np.diff(np.r_[starts, len(sym)])
        over = least == NEVER
        if (ties := ~over & pairs.shared[np.where(over, 0, least)]).any():
            for k in np.flatnonzero(ties).tolist():
                ended = _one_by_one(sym[starts[k] : starts[k] + sizes[k]].tolist(), pairs)
                done_sym.append(np.array(ended, dtype=np.int64))
                done_word.append(np.full(len(ended), word[starts[k]]))
            stay = np.repeat(~ties, sizes)
            sym, word, rank, result = sym[stay], word[stay], rank[stay], result[stay]
            least, sizes, over = least[~ties], sizes[~ties], over[~ties]
        if over.any():
            gone = np.repeat(over, sizes)
            done_sym.append(sym[gone])
            done_word.append(word[gone])
            stay = ~gone
            sym, word, rank, result = sym[stay], word[stay], rank[stay], result[stay]
            least, sizes = least[~over], sizes[~over]
        if not len(sym):
            break
        at = np.flatnonzero(rank == np.repeat(least, sizes))
        at = _together(at, word[at], pairs.spread[result[at]], pairs.reach)
        sym[at] = result[at]
        stay = np.ones(len(sym), dtype=bool)
        stay[at + 1] = False
        new = at - np.arange(len(at))
        sym, word, rank, result = sym[stay], word[stay], rank[stay], result[stay]
        touched = np.zeros(len(sym), dtype=bool)
        touched[new] = touched[np.maximum(new, 1) - 1] = True
        inner = np.flatnonzero(touched[:-1])
        r, to = pairs.look(sym[inner], sym[inner + 1])
        r[word[inner] != word[inner + 1]] = NEVER
        rank[inner], result[inner] = r, to
        rank[-1] = NEVER
    if not done_sym:
        return np.zeros(0, np.int64), np.zeros(n_words, np.int64)
    sym, word = np.concatenate(done_sym), np.concatenate(done_word)
    order = np.argsort(word, kind="stable")
    return sym[order], np.bincount(word, minlength=n_words)


@dataclass
class PieceVocabulary:
    """A BPE model of the sentencepiece library: pieces, merges, and how texts become words."""

    pieces: list[str]
    kinds: str
    byte_ids: np.ndarray
    pairs: Pairs
    chars: tuple[np.ndarray, np.ndarray]
    pattern: str
    alone: bool
    _codes: np.ndarray | None = field(default=None, repr=False)

    @classmethod
    def load(cls, path: str) -> PieceVocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        kinds = "".join(
            "C" if model.is_control(i) else "U" if model.is_unknown(i) else "B" if model.is_byte(i) else "N"
            for i in range(n)
        )
        byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int64)
        normal = {p: i for i, p in enumerate(pieces) if kinds[i] == "N"}
        scores = sorted({model.get_score(i) for i in normal.values()}, reverse=True)
        ranks = {s: r for r, s in enumerate(scores)}
        symbols = dict(normal)
        for p in normal:  # characters that only occur inside pieces are symbols, too
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        base = max(symbols.values()) + 1
        found = {}
        for p, i in normal.items():
            for j in range(1, len(p)):
                if (a := symbols.get(p[:j])) is not None and (b := symbols.get(p[j:])) is not None:
                    found[a, b] = (ranks[model.get_score(i)], i)
        single = sorted((ord(p), i) for p, i in symbols.items() if len(p) == 1)
        chars = tuple(np.array(x, dtype=np.int64) for x in zip(*single, strict=True))
        if any(SPACE in p.lstrip(SPACE) for p in normal):
            raise ValueError("a piece holds a space after another character: texts can't be cut before spaces")
        alone = "" if any("\n" in p and len(p) > 1 for p in normal) else "\\n"
        pattern = f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + ("|\\n" if alone else "")
        longest = max(map(len, normal))
        return cls(pieces, kinds, byte_ids, Pairs.build(found, base, longest), chars, pattern, bool(alone))

    def words(self, text: str) -> list[str]:
        """Keys of the text's words; no merge crosses from one to the next.

        A key is what follows a single space, or BARE and the word itself.
        """
        if not text:
            return []
        if "  " in text or text[0] == " " or SPACE in text or BARE in text:  # a run of spaces is part of a word
            return [BARE + w for w in re.findall(self.pattern, SPACE + text.replace(" ", SPACE))]
        if self.alone:
            text = text.replace("\n", f" {BARE}\n {BARE}")
        return text.split(" ")

    def encode_words(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words, one after another, and how many each has."""
        words = [k[1:] if k[:1] == BARE else SPACE + k for k in keys]
        if self._codes is None:
            self._codes = np.full(0x110000, -1, dtype=np.int64)
            self._codes[self.chars[0]] = self.chars[1]
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        codes = self._codes[points]
        strange = codes < 0
        codes[strange] = -1 - points[strange]
        sym, counts = merge_rounds(codes, lengths, self.pairs)
        loose = (sym < 0) | (sym >= len(self.pieces))
        if not loose.any():
            return sym.astype(np.int32), counts
        back = {int(i): int(c) for c, i in zip(*self.chars, strict=True) if i >= len(self.pieces)}
        width, spelt = np.ones(len(sym), dtype=np.int64), {}
        for i in np.flatnonzero(loose).tolist():
            s = int(sym[i])
            raw = chr(back[s] if s >= 0 else -1 - s).encode("utf-8", "surrogatepass")
            spelt[i], width[i] = self.byte_ids[list(raw)], len(raw)
        flat, ends = np.repeat(sym, width), np.cumsum(width)
        for i, ids in spelt.items():
            flat[ends[i] - width[i] : ends[i]] = ids
        owner = np.repeat(np.arange(len(words)), counts)
        return flat.astype(np.int32), np.bincount(owner, weights=width, minlength=len(words)).astype(np.int64)

    def decoder(self) -> Decoder:
        return Decoder(self)


class Decoder:
    """Texts of id lists."""

    def __init__(self, vocabulary: PieceVocabulary) -> None:
        self.kinds = vocabulary.kinds
        raw = []
        for i, p in enumerate(vocabulary.pieces):
            kind = vocabulary.kinds[i]
            raw.append(
                b"" if kind == "C" else " ⁇ ".encode() if kind == "U" else bytes([int(p[3:5], 16)]) if kind == "B" else p.replace(SPACE, " ").encode()
            )
        self.raw = raw

    def text(self, ids: list[int]) -> str:
        """The text; a byte that is no valid UTF-8 becomes U+FFFD; the first piece loses its leading space."""
        parts = list(map(self.raw.__getitem__, ids))
        first = next((i for i, x in enumerate(ids) if self.kinds[x] != "C"), None)
        if first is not None and self.kinds[ids[first]] == "N" and parts[first][:1] == b" ":
            parts[first] = parts[first][1:]
        joined = b"".join(parts)
        try:
            return joined.decode()
        except UnicodeDecodeError:
            return _lenient(joined)


def _lenient(raw: bytes) -> str:
    out, i = [], 0
    while i < len(raw):
        for n in (1, 2, 3, 4):
            try:
                out.append(raw[i : i + n].decode())
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            i += 1
    return "".join(out)


class WordCache:
    """Encodes texts by way of their distinct words, which it remembers up to ``limit`` of them.

    The limit bounds memory alone: beyond it the words are forgotten and encoded anew.
    """

    def __init__(self, vocabulary, limit: int = 400_000) -> None:
        self.vocabulary, self.limit = vocabulary, limit
        self.forget()

    def forget(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def _learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.index) > self.limit:
            self.forget()
        index, known, found, counts = self.index, len(self.index), [], []
        for t in texts:
            words = self.vocabulary.words(t)
            counts.append(len(words))
            found.extend([index.setdefault(w, len(index)) for w in words])
        if len(index) > known:
            flat, lengths = self.vocabulary.encode_words(list(index)[known:])
            self.flat, self.lengths = np.concatenate([self.flat, flat]), np.concatenate([self.lengths, lengths])
        return np.array(found, dtype=np.int64), np.array(counts, dtype=np.int64)

    def counts(self, texts: list[str]) -> np.ndarray:
        """How many tokens each text has."""
        found, words = self._learn(texts)
        total = np.r_[0, np.cumsum(self.lengths[found])]
        ends = np.cumsum(words)
        return total[ends] - total[ends - words]

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after another, and the offsets between texts."""
        found, words = self._learn(texts)
        lengths = self.lengths[found]
        total = np.r_[0, np.cumsum(lengths)]
        starts = np.r_[0, np.cumsum(self.lengths)][found]
        flat = self.flat[np.repeat(starts - total[:-1], lengths) + np.arange(total[-1])]
        return flat, total[np.r_[0, np.cumsum(words)]]


def list_array(flat: np.ndarray, offsets: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat.astype(np.int32)))
