"""Byte-level BPE: the vocabulary file, pre-tokens, the offline proof of whole tokens, and merging by a pair occurrence index."""

from __future__ import annotations

import heapq
import json
from functools import lru_cache

import numpy as np
import regex
from public_tokenizers import PATTERN

#: Letters and numbers that the regex module has and the tokenizers library, of an older Unicode version, has not.
NEWER = [(0x558, 0x558), (0x58B, 0x58C), (0x88F, 0x88F), (0xC5C, 0xC5C), (0xCDC, 0xCDC), (0x208F, 0x208F), (0x209D, 0x209F), (0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2), (0xA7D4, 0xA7D4), (0xA7DD, 0xA7DD), (0xA7E2, 0xA7E2), (0xA7F1, 0xA7F1), (0xAB6C, 0xAB6D), (0x107BB, 0x107BF), (0x10940, 0x10959), (0x10EC5, 0x10EC7), (0x10ED9, 0x10EEE), (0x11B0A, 0x11B0A), (0x11DB0, 0x11DDB), (0x11DE0, 0x11DE9), (0x11DF1, 0x11DF1), (0x1246F, 0x1246F), (0x12475, 0x1247F), (0x12550, 0x12686), (0x16EA0, 0x16EB8), (0x16EBB, 0x16ED3), (0x16FF2, 0x16FF6), (0x187F8, 0x187FF), (0x18CD6, 0x18CDA), (0x18D09, 0x18D20), (0x18D80, 0x18DF2), (0x18E00, 0x19191), (0x191A0, 0x191D2), (0x1B123, 0x1B128), (0x1B168, 0x1B168), (0x1D6A6, 0x1D6A6), (0x1DF1F, 0x1DF24), (0x1DF2B, 0x1DF81), (0x1DF90, 0x1DF96), (0x1DFCD, 0x1DFFF), (0x1E6C0, 0x1E6DE), (0x1E6E0, 0x1E6E2), (0x1E6E4, 0x1E6E5), (0x1E6E7, 0x1E6ED), (0x1E6F0, 0x1E6F4), (0x1E6FE, 0x1E6FF), (0x2B73A, 0x2B73F), (0x2B81E, 0x2B81E), (0x2CEA2, 0x2CEAD), (0x323B0, 0x33479), (0x3D000, 0x3FC3F)]


@lru_cache(maxsize=1)
def pretokens() -> regex.Pattern:
    """The pattern, with ``NEWER`` taken for neither letters nor numbers."""
    ranges = "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER)
    slow = r"'s|'t|'re|'ve|'m|'ll|'d| ?(?:(?![NEW])\p{L})+| ?(?:(?![NEW])\p{N})+| ?(?:[NEW]|[^\s\p{L}\p{N}])+|\s+(?!\S)|\s+"
    return regex.compile(slow.replace("NEW", ranges))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 stands for itself, the rest follows from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """A byte-level BPE file of the tokenizers library, read once in each process."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        ids = {raw(token): i for token, i in data["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        size = max([*ids.values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in ids.items():
            self.token_bytes[i] = token
        for content, i in self.special.items():
            self.token_bytes[i] = content.encode()
        pairs = [m if isinstance(m, list) else m.split(" ") for m in data["model"]["merges"]]
        left, right = ([ids[raw(p[k])] for p in pairs] for k in (0, 1))
        self.left, self.right = np.array(left, np.int64), np.array(right, np.int64)
        self.result = np.array([ids[self.token_bytes[a] + self.token_bytes[b]] for a, b in zip(left, right)], np.int64)
        self.ranks = {(a, b): (r, int(c)) for r, (a, b, c) in enumerate(zip(left, right, self.result))}
        self.byte_ids = np.array([ids[bytes([b])] for b in range(256)], np.int64)
        keys = self.left << 32 | self.right
        self.key_order = np.argsort(keys, kind="stable")
        self.keys = keys[self.key_order]
        self.pattern = regex.compile(PATTERN)
        self.careful = pretokens()
        self.newer = regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in NEWER) + "]")
        self.special_pattern = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens in order; a special token inside the text is a piece of its own."""
        find = self.pattern.findall if text.isascii() or not self.newer.search(text) else self.careful.findall
        if not any(s in text for s in self.special):
            return find(text)
        out: list[str] = []
        for part in self.special_pattern.split(text):
            out += [part] if part in self.special else find(part)
        return out

    def proven_whole(self) -> list[bytes]:
        """Vocabulary strings that encode alone as exactly one token: each is merged from its bytes, and the outcome compared.

        A string that no merge path reaches as a whole isn't proven and takes the general way.
        """
        special = set(self.special.values())
        tokens = [t for i, t in enumerate(self.token_bytes) if t and i not in special]
        flat, offsets = PairIndex(self).encode(tokens)
        return [t for t, n in zip(tokens, np.diff(offsets)) if n == 1]

    @property
    def monotone(self) -> bool:
        """Whether each merge joins parts made by earlier merges, so that merging all places of a pair at once equals one by one."""
        made = {int(b) for b in self.byte_ids}
        for a, b, c in zip(self.left, self.right, self.result):
            if int(a) not in made or int(b) not in made:
                return False
            made.add(int(c))
        return True


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    """A vocabulary whose merges can be applied to all places of a pair at once; others are an error."""
    found = Vocabulary(path)
    if not found.monotone:
        raise ValueError(f"{path}: a merge comes before those that make its parts")
    return found


class PairIndex:
    """Encodes many pre-tokens together.

    All symbols lie in one array with links to their neighbours. Each pair's positions are listed under its rank; a heap
    of active ranks is emptied in ascending order; a merge rewrites its positions and files the pairs that it makes.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        first = np.full((256, 256), -1, np.int64)
        where = {int(i): b for b, i in enumerate(vocabulary.byte_ids)}
        for (a, b), (rank, _) in vocabulary.ranks.items():
            if a in where and b in where:
                first[where[a], where[b]] = rank
        self.first = first.ravel()

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << 32 | b
        at = np.searchsorted(self.v.keys, key)
        at[at == len(self.v.keys)] = 0
        return np.where(self.v.keys[at] == key, self.v.key_order[at], -1)

    def encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and the offsets of the words in them."""
        v = self.v
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        starts = np.cumsum(lengths) - lengths
        sym = v.byte_ids[data]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        full = lengths > 0
        nxt[(starts + lengths - 1)[full]] = -1
        prv[starts[full]] = -1
        index: dict[int, list[np.ndarray]] = {}
        heap: list[int] = []

        def file(positions: np.ndarray, ranks: np.ndarray) -> None:
            known = ranks >= 0
            positions, ranks = positions[known], ranks[known]
            if not len(ranks):
                return
            order = np.argsort(ranks, kind="stable")
            positions, ranks = positions[order], ranks[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            heads = ranks[np.concatenate(([0], cuts))].tolist()
            lo = 0
            for rank, hi in zip(heads, [*cuts.tolist(), len(ranks)]):
                if rank in index:
                    index[rank].append(positions[lo:hi])
                else:
                    index[rank] = [positions[lo:hi]]
                    heapq.heappush(heap, rank)
                lo = hi

        inner = np.flatnonzero(nxt >= 0)
        file(inner, self.first[data[inner].astype(np.int64) * 256 + data[inner + 1]])
        while heap:
            rank = heapq.heappop(heap)
            lists = index.pop(rank)
            pos = lists[0] if len(lists) == 1 else np.unique(np.concatenate(lists))
            a, b = v.left[rank], v.right[rank]
            follow = nxt[pos]
            good = (sym[pos] == a) & (follow >= 0)
            good &= sym[follow] == b
            if not good.all():
                pos, follow = pos[good], follow[good]
            if a == b and len(pos) > 1:  # a run of one symbol is taken two by two from the left
                head = np.concatenate(([True], follow[:-1] != pos[1:]))
                at = np.arange(len(pos))
                keep = (at - np.maximum.accumulate(np.where(head, at, 0))) % 2 == 0
                pos, follow = pos[keep], follow[keep]
            if not len(pos):
                continue
            sym[pos] = v.result[rank]
            sym[follow] = -1
            after = nxt[follow]
            nxt[pos] = after
            has = after >= 0
            prv[after[has]] = pos[has]
            before = prv[pos]
            before = before[before >= 0]
            changed = np.unique(np.concatenate((before, pos[has])))  # a place next to two merges is listed once
            if len(changed):
                file(changed, self.rank_of(sym[changed], sym[nxt[changed]]))
        alive = sym >= 0
        count = np.concatenate(([0], np.cumsum(alive)))
        offsets = np.concatenate((count[starts], [count[-1]]))
        return sym[alive].astype(np.uint32), offsets
