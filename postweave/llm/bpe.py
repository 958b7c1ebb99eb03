"""Byte-pair encoding of whole batches by rank-synchronous merging.

Pre-tokens lie behind each other in one flat array. In a round every sequence
finds its pair of lowest rank and merges all its places at once, until no
sequence has a pair that can merge.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from postweave.llm.ragged import gather, split_words, sums

# Letters with a one-to-one lower case and no composition: up to U+024F without U+0130.
PLAIN = "^[\\x21-\\x7e\u00a1-\u012f\u0131-\u024f]*$"
# Distinct chunks whose ids a worker keeps: about 150 MB.
KNOWN = 1_000_000
NO_RANK = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in byte-level files."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    names = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class BatchBpe:
    """Token ids and counts of batches, as the file's own library gives them.

    Texts are cut at white space first, which no rule of the file's normaliser or
    pre-tokeniser looks across, so that each distinct chunk of a batch is merged
    once. Chunks with characters beyond Latin letters or with a special string
    are normalised and split by the library; merging is the same for all.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        vocab, suffix = spec["model"]["vocab"], spec["model"]["end_of_word_suffix"]
        self.size = len(vocab)
        names = byte_characters()
        self.byte_of = {c: b for b, c in enumerate(names)}
        self.inner = np.array([vocab[c] for c in names], np.int32)
        self.last = np.array([vocab[c + suffix] for c in names], np.int32)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        left = np.array([vocab[a] for a, _ in merges], np.int64)
        right = np.array([vocab[b] for _, b in merges], np.int64)
        self.product = np.array([vocab[a + b] for a, b in merges], np.int32)
        self._index(left * self.size + right)
        # A merge whose product takes part in an earlier one goes place by place.
        earliest = np.full(self.size, NO_RANK, np.int64)
        ranks = np.arange(len(merges))
        np.minimum.at(earliest, left, ranks)
        np.minimum.at(earliest, right, ranks)
        self.one_by_one = earliest[self.product] < ranks
        self.known = pa.array([], pa.large_string())
        self.known_ids, self.known_counts = np.zeros(0, np.int32), np.zeros(0, np.int64)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_parts = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        # Fixed value: the pre-token pattern of the file, and a mark between chunks.
        self.parts = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+|\n")

    def _index(self, keys: np.ndarray) -> None:
        """Open table of pair keys, read by arrays of keys."""
        self.bits = 20
        self.keys = np.full((1 << self.bits) + 64, -1, np.int64)
        self.ranks = np.full(len(self.keys), NO_RANK, np.int32)
        for rank, (key, at) in enumerate(zip(keys.tolist(), self._slot(keys).tolist(), strict=True)):
            while self.keys[at] >= 0:
                at += 1
            self.keys[at], self.ranks[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.keys[at]
        out = np.where(found == keys, self.ranks[at], NO_RANK)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        while len(open_):
            at[open_] += 1
            found = self.keys[at[open_]]
            own = found == keys[open_]
            out[open_[own]] = self.ranks[at[open_[own]]]
            open_ = open_[~own & (found >= 0)]
        return out

    def merge(self, ids: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Surviving ids of ragged sequences, none empty, and their number each."""
        owner = np.repeat(np.arange(len(counts)), counts)
        done_ids, done_owner = [], []
        while len(ids):
            ranks = np.full(len(ids), NO_RANK, np.int32)
            inside = np.flatnonzero(owner[1:] == owner[:-1])
            ranks[inside] = self.rank(ids[inside].astype(np.int64) * self.size + ids[inside + 1])
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lengths = np.diff(np.r_[starts, len(ids)])
            lowest = np.repeat(np.minimum.reduceat(ranks, starts), lengths)
            active = lowest != NO_RANK
            if not active.all():
                done_ids.append(ids[~active])
                done_owner.append(owner[~active])
                ids, owner, ranks, lowest = ids[active], owner[active], ranks[active], lowest[active]
                if not len(ids):
                    break
            hits = np.flatnonzero(ranks == lowest)
            hits = self._apart(hits, owner, ranks)
            ids = ids.copy()
            ids[hits] = self.product[ranks[hits]]
            left = np.ones(len(ids), bool)
            left[hits + 1] = False
            ids, owner = ids[left], owner[left]
        if not done_ids:
            return ids, np.zeros(len(counts), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(counts))

    def _apart(self, hits: np.ndarray, owner: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Places that merge at once: of a run of touching places every other one."""
        touching = np.r_[False, (hits[1:] == hits[:-1] + 1) & (owner[hits[1:]] == owner[hits[:-1]])]
        if touching.any():
            at = np.arange(len(hits))
            run = np.maximum.accumulate(np.where(touching, 0, at))
            hits = hits[(at - run) % 2 == 0]
        single = self.one_by_one[ranks[hits]]
        if single.any():
            again = np.r_[False, owner[hits[1:]] == owner[hits[:-1]]]
            hits = hits[~(single & again)]
        return hits

    def _pre_tokens(self, chunks: pa.Array) -> tuple[pa.Array, np.ndarray, dict[int, int]]:
        """Flat pre-tokens as bytes, their number per chunk, and special ids by place."""
        if not len(chunks):
            return pa.array([], pa.large_binary()), np.zeros(0, np.int64), {}
        plain = pc.and_(
            pc.match_substring_regex(chunks, PLAIN), pc.invert(pc.match_substring(chunks, "<|"))
        ).to_numpy(zero_copy_only=False)
        order = np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]
        lower = "\n".join(pc.utf8_lower(chunks.filter(pa.array(plain))).to_pylist())
        parts = pa.array(self.parts.findall(lower), pa.large_string())
        counts = np.zeros(len(chunks), np.int64)
        n_plain = int(plain.sum())
        if n_plain:
            breaks = pc.equal(parts, "\n").to_numpy(zero_copy_only=False)
            ends = np.r_[np.flatnonzero(breaks), len(parts)]
            counts[:n_plain] = np.diff(np.r_[-1, ends]) - 1
            parts = parts.filter(pa.array(~breaks))
        rest, special = [], {}
        for i, chunk in enumerate(chunks.filter(pa.array(~plain)).to_pylist(), n_plain):
            before = len(rest)
            for piece in filter(None, self.special_parts.split(chunk)):
                if piece in self.special:
                    special[len(parts) + len(rest)] = self.special[piece]
                    rest.append(b" ")
                    continue
                plain_piece = self.library.normalizer.normalize_str(piece)
                for token, _ in self.library.pre_tokenizer.pre_tokenize_str(plain_piece):
                    rest.append(bytes(self.byte_of[c] for c in token))
            counts[i] = len(rest) - before
        flat = pa.concat_arrays([parts.cast(pa.large_binary()), pa.array(rest, pa.large_binary())])
        # Back to the order of the chunks.
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        index, _ = gather(np.arange(len(flat)), np.cumsum(counts), place)
        moved = {}
        if special:
            new_of = np.empty(len(flat), np.int64)
            new_of[index] = np.arange(len(flat))
            moved = {int(new_of[k]): v for k, v in special.items()}
        return flat.take(pa.array(index)), counts[place], moved

    def _merged(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct chunks behind each other, and their number per chunk."""
        pre, n_pre, special = self._pre_tokens(chunks)
        kinds = pre.dictionary_encode()
        raw = kinds.dictionary
        lengths = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        data = np.frombuffer(b"".join(raw.to_pylist()), np.uint8)
        ids = self.inner[data]
        ids[np.cumsum(lengths) - 1] = self.last[data[np.cumsum(lengths) - 1]]
        ids, n_ids = self.merge(ids, lengths)
        which = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        for place, token in special.items():
            which[place] = len(n_ids)
            ids, n_ids = np.r_[ids, np.int32(token)], np.r_[n_ids, 1]
        flat, lengths = gather(ids, np.cumsum(n_ids), which)
        return flat, sums(lengths, n_pre)

    def _encoded(self, texts: pa.Array):
        """Chunk of each word, words per text, and the ids of the chunks.

        The first KNOWN distinct chunks of a worker are merged once for all
        batches; others are merged anew in each batch.
        """
        words, n_words = split_words(texts, lower=False)
        coded = words.dictionary_encode()
        at = pc.index_in(coded.dictionary, value_set=self.known)
        fresh = coded.dictionary.filter(pc.is_null(at))
        new_ids, new_counts = self._merged(fresh)
        ids, counts = np.r_[self.known_ids, new_ids], np.r_[self.known_counts, new_counts]
        place = pc.fill_null(at, -1).to_numpy(zero_copy_only=False).astype(np.int64)
        place[place < 0] = len(self.known) + np.arange(len(fresh))
        if len(self.known) + len(fresh) <= KNOWN:
            self.known = pa.concat_arrays([self.known, fresh])
            self.known_ids, self.known_counts = ids, counts
        chunk = place[coded.indices.to_numpy(zero_copy_only=False)]
        return chunk, n_words, ids, counts

    def count(self, texts: pa.Array) -> np.ndarray:
        """Number of tokens of each text; null and empty texts have none."""
        chunk, n_words, _, counts = self._encoded(texts)
        return sums(counts[chunk], n_words)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts behind each other, and their number per text."""
        chunk, n_words, ids, counts = self._encoded(texts)
        flat, lengths = gather(ids, np.cumsum(counts), chunk)
        return flat, sums(lengths, n_words)


@lru_cache(maxsize=2)
def tokenizer(path: str) -> BatchBpe:
    """One per worker process and file."""
    return BatchBpe(path)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
