"""Passages of evaluation items inside a corpus: q-gram filter over diagonal bands, then banded alignment."""

from __future__ import annotations

import html
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a q-gram: one 8-byte integer holds it.
Q = 8
#: A passage leaks if so many consecutive words of the item stand in the document ...
EXACT_WORDS = 13
#: ... or at least so many words with no more than one in EDIT_SHARE changed, added or left out.
LOOSE_WORDS, EDIT_SHARE = 24, 8
#: Kinds of passages, (words, edits): one without edits, and those that every loose passage contains one of. A passage of
#: n words with n // EDIT_SHARE edits falls into pieces of these lengths, of which one keeps within its own budget.
PASSAGES = ((EXACT_WORDS, 0), (LOOSE_WORDS, LOOSE_WORDS // EDIT_SHARE), (LOOSE_WORDS + EDIT_SHARE, LOOSE_WORDS // EDIT_SHARE + 1), (LOOSE_WORDS + 2 * EDIT_SHARE, LOOSE_WORDS // EDIT_SHARE + 2))
#: Bands hold twice so many diagonals, counted in words, and begin every so many. The edits of a kind, and as many words
#: again that breaks part or join, shift the diagonal by fewer.
BAND = 16
#: Shared q-grams that are looked at together, and passages that are aligned together.
PORTION, STARTS = 2_000_000, 4_096
#: Bits of the table that tells q-grams of no item at once, and fixed odd numbers of the hash.
_FILTER_BITS = 22
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_NEVER = 1 << 60
#: Items are searched in blocks of about so many characters, so that the index sent to the workers has a bound.
BLOCK_CHARS = 8_000_000

_TAG = re.compile(r"<!--.*?-->|</?([a-zA-Z][a-zA-Z0-9]*)(?:\s[^<>]*)?/?>", re.S)
_INLINE = {"a", "abbr", "b", "big", "code", "del", "em", "font", "i", "ins", "mark", "s", "small", "span", "strong", "sub", "sup", "tt", "u", "wbr"}
_BROKEN = re.compile(r"(?<=[^\W\d_])[-‐‑][ \t]*(?:\r\n|\r|\n)\s*(?=[^\W\d_])")
_WORD = re.compile(r"[^\W_]+")
_HIDDEN = re.compile("[­​-‏⁠﻿]")


def plain(text: str) -> str:
    """Lower-case text without markup, hidden characters, accents and word breaks at line ends."""
    if "<" in text:
        text = _TAG.sub(lambda m: "" if (m.group(1) or "").lower() in _INLINE else " ", text)
    if "&" in text:
        text = html.unescape(text)
    text = _BROKEN.sub("", _HIDDEN.sub("", text))
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))
    return text.casefold()


def words(text: str) -> list[str]:
    return _WORD.findall(plain(text))


def joined(tokens: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words without gaps, and where each word starts; the last start is the end of all."""
    codes = np.frombuffer("".join(tokens).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.r_[0, np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)))]


def _grams(codes: np.ndarray) -> np.ndarray:
    """The q-grams of code points as hashes. Equal q-grams have equal hashes; unequal ones that agree cost time only."""
    if len(codes) < Q:
        return np.empty(0, dtype=np.uint64)
    n = len(codes) - Q + 1
    out = np.zeros(n, dtype=np.uint64)
    for i in range(Q):
        out = out * _BASE + codes[i : i + n]
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return out ^ (out >> np.uint64(32))


def _slot(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)


def edit_budget_bounds(lengths: np.ndarray) -> np.ndarray:
    """The least number of q-grams that a leaked passage shares with its place in the document, per kind of PASSAGES.

    A passage without edits keeps all its q-grams. An edit destroys at most the q-grams that touch one word: its length
    plus Q - 1. The bound is the least over all passages of the item; kinds longer than the item get no passage.
    """
    out = []
    for n, edits in PASSAGES:
        if len(lengths) < n:
            out.append(_NEVER)
            continue
        least = _NEVER
        for lo in range(0, len(lengths) - n + 1, 1 << 16):
            windows = np.lib.stride_tricks.sliding_window_view(lengths[lo : lo + (1 << 16) + n - 1], n)
            kept = windows.sum(1) - Q + 1
            if edits:
                kept = kept - np.partition(windows, n - edits, axis=1)[:, n - edits :].sum(1) - edits * (Q - 1)
            least = min(least, int(kept.min()))
        out.append(max(1, least))
    return np.array(out, dtype=np.int64)


class ItemIndex:
    """Q-grams of a block of items with where they stand, as arrays that travel to the workers as they are."""

    def __init__(self, items: list[tuple[int, str]]):
        self.ids, self.texts, self.starts, bounds = [], [], [], []
        grams, owner, place, word = [], [], [], []
        for item_id, text in items:
            tokens = words(text or "")
            if len(tokens) < EXACT_WORDS:
                continue  # too short to leak
            codes, starts = joined(tokens)
            g = _grams(codes)
            grams.append(g)
            owner.append(np.full(len(g), len(self.ids), dtype=np.int32))
            place.append(np.arange(len(g), dtype=np.int64))
            word.append(np.searchsorted(starts, place[-1], side="right") - 1)
            self.ids.append(item_id)
            self.texts.append("".join(tokens))
            self.starts.append(starts)
            bounds.append(edit_budget_bounds(np.diff(starts)))
        g = np.concatenate(grams) if grams else np.empty(0, dtype=np.uint64)
        order = np.argsort(g, kind="stable")
        g = g[order]
        self.owner = np.concatenate(owner)[order] if grams else np.empty(0, dtype=np.int32)
        self.place = np.concatenate(place)[order] if grams else np.empty(0, dtype=np.int64)
        self.word = np.concatenate(word)[order] if grams else np.empty(0, dtype=np.int64)
        self.grams, self.start = np.unique(g, return_index=True)
        self.count = np.diff(np.r_[self.start, len(g)])
        self.table = np.zeros(1 << _FILTER_BITS, dtype=bool)
        self.table[_slot(self.grams)] = True
        self.bounds = np.array(bounds, dtype=np.int64).reshape(-1, len(PASSAGES))
        self.least = self.bounds.min(axis=1) if len(self.bounds) else np.empty(0, dtype=np.int64)

    def _entries(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the document whose q-gram some item holds, and the number of that q-gram."""
        g = _grams(codes)
        at = np.flatnonzero(self.table[_slot(g)])
        k = np.searchsorted(self.grams, g[at])
        k[k == len(self.grams)] = 0
        hit = self.grams[k] == g[at] if len(self.grams) else np.zeros(len(at), dtype=bool)
        return at[hit], k[hit]

    def _hits(self, at: np.ndarray, k: np.ndarray, wanted: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of a place and an entry of the index, of wanted owners only, in portions of bounded size."""
        n = self.count[k]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(at):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PORTION, side="right")))
            m = n[lo:hi]
            entry = np.repeat(self.start[k[lo:hi]] - np.r_[0, np.cumsum(m)[:-1]], m) + np.arange(m.sum())
            pos = np.repeat(at[lo:hi], m)
            if wanted is not None:
                keep = wanted[self.owner[entry]]
                pos, entry = pos[keep], entry[keep]
            yield pos, entry
            lo = hi

    def leaked(self, tokens: list[str]) -> list[int]:
        """Ids of the items of which a text, as its words, carries a passage."""
        if len(tokens) < EXACT_WORDS or not self.ids:
            return []
        codes, starts = joined(tokens)
        at, k = self._entries(codes)
        if len(at) == 0:
            return []
        shared = np.zeros(len(self.ids), dtype=np.int64)
        for _, entry in self._hits(at, k, None):
            shared += np.bincount(self.owner[entry], minlength=len(self.ids))
        wanted = shared >= self.least
        if not wanted.any():
            return []
        found = self._exact(tokens, starts, at, k, wanted)
        rest = wanted & ~found
        if rest.any():
            found |= self._loose(tokens, starts, at, k, rest)
        return sorted({self.ids[o] for o in np.flatnonzero(found)})

    def _exact(self, tokens: list[str], starts: np.ndarray, at: np.ndarray, k: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Items of which a run of words stands unchanged, however the document parts the words.

        Such a run lies on one diagonal of characters, and its q-grams follow each other there.
        """
        found = np.zeros(len(self.ids), dtype=bool)
        edge = np.zeros(int(starts[-1]) + 1, dtype=bool)
        edge[starts] = True
        runs: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for pos, entry in self._hits(at, k, wanted):
            owner, diagonal = self.owner[entry], pos - self.place[entry]
            order = np.lexsort((pos, diagonal, owner))
            owner, diagonal, pos = owner[order], diagonal[order], pos[order]
            new = np.r_[True, (owner[1:] != owner[:-1]) | (diagonal[1:] != diagonal[:-1]) | (pos[1:] != pos[:-1] + 1)]
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(pos)] - 1
            # Runs that a portion cuts are put together again, so short ones at its borders stay.
            long = (last - first + 1 >= self.bounds[owner[first], 0]) | (pos[first] == pos.min()) | (pos[last] == pos.max())
            for a, b in zip(first[long].tolist(), last[long].tolist()):
                own = runs.setdefault((int(owner[a]), int(diagonal[a])), [])
                if own and own[-1][1] + 1 == pos[a]:
                    own[-1] = (own[-1][0], int(pos[b]))
                else:
                    own.append((int(pos[a]), int(pos[b])))
        for (o, diagonal), spans in runs.items():
            if found[o]:
                continue
            s = self.starts[o]
            for a, b in spans:
                if b - a + 1 < self.bounds[o, 0]:
                    continue
                i = int(np.searchsorted(s, a - diagonal))
                j = int(np.searchsorted(s, b + Q - diagonal, side="right")) - 1 - EXACT_WORDS
                if j < i:
                    continue
                begins, ends = s[i : j + 1] + diagonal, s[i + EXACT_WORDS : j + EXACT_WORDS + 1] + diagonal
                if (edge[begins] & edge[ends]).any():
                    found[o] = True
                    break
        return found

    def _loose(self, tokens: list[str], starts: np.ndarray, at: np.ndarray, k: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Items of which a passage with few edits stands, by bands of diagonals and alignment inside each band.

        A diagonal is the distance in words from an item's q-gram to the document's. An edit shifts it by one word, so a
        passage lies in one of the bands of twice BAND diagonals that begin every BAND.
        """
        found = np.zeros(len(self.ids), dtype=bool)
        counts: dict[tuple[int, int], int] = {}
        for pos, entry in self._hits(at, k, wanted):
            band = (np.searchsorted(starts, pos, side="right") - 1 - self.word[entry]) // BAND
            for (o, b), c in zip(*_counted(self.owner[entry].astype(np.int64), band)):
                counts[o, b] = counts.get((o, b), 0) + c
                counts[o, b - 1] = counts.get((o, b - 1), 0) + c
        least = self.bounds[:, 1:].min(axis=1)
        kept = sorted(((o, b) for (o, b), c in counts.items() if c >= least[o]), key=lambda x: -counts[x])
        if not kept:
            return found
        places: dict[tuple[int, int], list[np.ndarray]] = {x: [] for x in kept}
        near = np.zeros(len(self.ids), dtype=bool)
        near[[o for o, _ in kept]] = True
        for pos, entry in self._hits(at, k, near):
            band = (np.searchsorted(starts, pos, side="right") - 1 - self.word[entry]) // BAND
            owner, word = self.owner[entry].astype(np.int64), self.word[entry]
            order = np.lexsort((band, owner))
            owner, band, word = owner[order], band[order], word[order]
            cut = np.flatnonzero(np.r_[True, (owner[1:] != owner[:-1]) | (band[1:] != band[:-1])])
            for a, z in zip(cut.tolist(), np.r_[cut[1:], len(owner)].tolist()):
                for key in ((int(owner[a]), int(band[a])), (int(owner[a]), int(band[a]) - 1)):
                    if key in places:
                        places[key].append(word[a:z])
        for o, b in kept:
            if not found[o]:
                found[o] = self._aligned(o, tokens, b * BAND, np.concatenate(places[o, b]))
        return found

    def _aligned(self, o: int, tokens: list[str], low: int, hits: np.ndarray) -> bool:
        """Whether a loose passage of item o stands in the band of diagonals from low on; hits: its words with q-grams there."""
        n_words = len(self.starts[o]) - 1
        before = np.r_[0, np.cumsum(np.bincount(hits, minlength=n_words))]
        begin = np.zeros(n_words, dtype=bool)
        for kind, (n, _) in enumerate(PASSAGES):
            if kind and n <= n_words:
                begin[: n_words - n + 1] |= before[n:] - before[:-n] >= self.bounds[o, kind]
        at = np.flatnonzero(begin)
        if len(at) == 0:
            return False
        most = PASSAGES[-1][0]
        text, s = self.texts[o], self.starts[o]
        for lo in range(0, len(at), STARTS):
            i = at[lo : lo + STARTS]
            groups = np.split(i, np.flatnonzero(np.diff(i) > most) + 1)
            for g in groups:
                a, z = int(g[0]), min(n_words, int(g[-1]) + most)
                item = [text[s[x] : s[x + 1]] for x in range(a, z)]
                c = max(0, a + low)
                doc = tokens[c : max(c, min(len(tokens), z + low + 2 * BAND + 1))]
                if loose_passage(item, doc, a + low - c, g - a):
                    return True
        return False


def _counted(owner: np.ndarray, band: np.ndarray) -> tuple[list[tuple[int, int]], list[int]]:
    """Distinct pairs and how often each occurs."""
    if len(owner) == 0:
        return [], []
    order = np.lexsort((band, owner))
    o, b = owner[order], band[order]
    first = np.flatnonzero(np.r_[True, (o[1:] != o[:-1]) | (b[1:] != b[:-1])])
    return list(zip(o[first].tolist(), b[first].tolist())), np.diff(np.r_[first, len(o)]).tolist()


def loose_passage(item: list[str], doc: list[str], shift: int, begins: np.ndarray, width: int = 2 * BAND) -> bool:
    """Whether a loose passage of the item that begins at one of the given words stands in doc, aligned inside a band.

    The band holds the diagonals shift, ..., shift + width - 1: item word i faces the words i + shift and following.
    All beginnings are aligned at once, a row a word of the passage: a word changed, added or left out costs 1; two words
    that make one, on either side, cost nothing, since word breaks do not matter.
    """
    codes: dict[str, int] = {}
    d = np.array([codes.setdefault(t, len(codes)) for t in doc] or [0], dtype=np.int64)
    pairs = {}
    for j in range(len(doc) - 1):
        pairs.setdefault(doc[j] + doc[j + 1], []).append(j)
    n_item, m = len(item), len(doc)
    span = np.arange(width)
    j = np.arange(n_item)[:, None] + shift + span  # document word that faces item word i on each diagonal
    inside = (j >= 0) & (j < m)
    w = np.array([codes.get(t, -1) for t in item], dtype=np.int64)
    same = inside & (d[np.clip(j, 0, max(0, m - 1))] == w[:, None])
    # One item word made of two document words, and one document word made of two item words.
    two_doc = np.zeros((n_item, width), dtype=bool)
    two_item = np.zeros((n_item, width), dtype=bool)
    for i, t in enumerate(item):
        for x in pairs.get(t, ()):
            if 0 <= x - i - shift < width:
                two_doc[i, x - i - shift] = True
        if i + 1 < n_item and (c := codes.get(t + item[i + 1])) is not None:
            two_item[i] = inside[i] & (d[np.clip(j[i], 0, max(0, m - 1))] == c)
    parts = bool(two_doc.any() or two_item.any())
    most = max(e for _, e in PASSAGES)
    far = most + 1
    # state[k, s]: least edits when the next words are item word i and document word i + shift + s.
    row = np.where((begins[:, None] + shift + span >= 0) & (begins[:, None] + shift + span <= m), 0, far).astype(np.int16)
    older = np.full_like(row, far)
    joined_before = np.zeros_like(row, dtype=bool)
    budget = dict(PASSAGES)
    for step in range(1, max(n for n, _ in PASSAGES) + 1):
        i = begins + step - 1
        ok = i < n_item
        if not ok.any():
            return False
        at = np.minimum(i, n_item - 1)
        here = ok[:, None] & inside[at]
        nxt = np.where(here, row + ~same[at], far)
        nxt[:, :-1] = np.minimum(nxt[:, :-1], np.where(ok[:, None], row[:, 1:] + 1, far))
        if parts:
            nxt[:, 1:] = np.minimum(nxt[:, 1:], np.where(ok[:, None] & two_doc[at][:, :-1], row[:, :-1], far))
            nxt[:, :-1] = np.minimum(nxt[:, :-1], np.where(joined_before[:, 1:], older[:, 1:], far))
            joined_before = ok[:, None] & two_item[at]
            older = row
        nxt = np.minimum.accumulate(nxt - span, axis=1) + span  # words added
        row = np.minimum(nxt, far).astype(np.int16)
        if step in budget and step > EXACT_WORDS and (row <= budget[step]).any():
            return True
        live = (row <= most).any(axis=1) | ((older <= most).any(axis=1) if parts else False)
        if not live.all():
            if not live.any():
                return False
            begins, row, older, joined_before = begins[live], row[live], older[live], joined_before[live]
    return False


def leaked(text: str | None, index: ItemIndex) -> list[int]:
    """Ids of the items of which a text carries a passage."""
    return index.leaked(words(text)) if text else []


def _blocks(items: DataFrame, item_key: str, item_text: str) -> Iterator[list[tuple[int, str]]]:
    block, chars = [], 0
    for r in items.where(F.col(item_text).isNotNull()).select(item_key, item_text).distinct().toLocalIterator():
        block.append((r[0], r[1]))
        chars += len(r[1])
        if chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def leaks(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc_key, item_key) of every document that carries a passage of an item, distinct.

    Passage: EXACT_WORDS consecutive words of the item, or LOOSE_WORDS and more words with no more than one in
    EDIT_SHARE changed, added or left out. Case, punctuation, white space, markup, accents, hidden characters and word
    breaks at line ends do not matter. Null, empty and short texts and items carry nothing; repeated rows and documents
    count on their own; ids are long. Whole texts of any length and script are searched, against whole items. No items or
    no documents give no rows.

    The items are a stated query set: the driver indexes them in blocks of about BLOCK_CHARS characters, each index goes
    to the workers once (about 30 bytes a character), and every document is searched for each.
    """
    out = None
    for block in _blocks(items, item_key, item_text):
        shared = docs.sparkSession.sparkContext.broadcast(cloudpickle.dumps(ItemIndex(block)))

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = cloudpickle.loads(shared.value)
            for pdf in batches:
                rows = [(k, i) for k, t in zip(pdf["k"], pdf["t"]) for i in leaked(t, index)]
                yield pd.DataFrame(rows, columns=["k", "i"])

        rows = docs.where(F.col(doc_text).isNotNull()).select(F.col(doc_key).cast("long").alias("k"), F.col(doc_text).alias("t")).mapInPandas(search, "k long, i long")
        out = rows if out is None else out.union(rows)
    if out is None:
        out = docs.select(F.col(doc_key).cast("long").alias("k"), F.lit(None).cast("long").alias("i")).limit(0)
    return out.select(F.col("k").alias(doc_key), F.col("i").alias(item_key)).distinct()
