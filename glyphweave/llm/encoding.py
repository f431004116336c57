"""Token ids of whole texts with the public word-end BPE vocabulary.

Its pre-tokenizer cuts a text at white space and then into letter runs, single
digits and symbol runs, each encoded on its own and closed by a word-end token.
So a batch's words are found and compared as bytes with numpy, words not seen
lately are cut into pieces and merged together, and ids are gathered from there.
Whatever that shortcut can't be sure of (unusual white space, letters beyond
Latin, special tokens) goes through the tokenizer as it is, which gives the same ids.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex

from glyphweave.llm import texthash

#: Fixed value: the vocabulary's own pre-tokenizer pattern.
_PIECE = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: From here on (and at the dotted capital I) a character's normal or lower form needn't be one character.
FAR, DOTTED = 0x250, 0x130
_KIND = np.array([{"L": 1, "N": 2}.get(unicodedata.category(chr(c))[0], 3) for c in range(FAR)], np.uint8)
_LOWER = np.array([ord(chr(c).lower()[0]) for c in range(FAR)], np.uint32)
#: First bytes of white space that str.split and the vocabulary's pattern may see differently, and its other forms.
_ODD_LEAD = np.zeros(256, bool)
_ODD_LEAD[[0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3]] = True
_ODD = regex.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
#: Words of up to so many bytes are kept in a table of 2**SLOT_BITS places, where a newer word takes an older one's.
SHORT, SLOT_BITS = 16, 20
#: Ids of kept words; beyond it the table is cleared.
KEPT_IDS = 4_000_000
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies, by its published rule."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All positions of runs that begin at `starts`, one run after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


class WordEncoder:
    """Ids equal to encoding whole texts without special tokens; null and empty texts have none.

    Words are told apart by all their bytes, never by a hash alone. What is kept
    between calls is bounded by the table's places and KEPT_IDS. Words are merged by
    a second engine over the same ranks, with a space as the word end, since pieces
    hold no white space.
    """

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        spec = json.loads(self.tokenizer.to_str())
        special = {t["content"] for t in spec["added_tokens"]}
        if not all(t.startswith("<|") and not t.split()[1:] for t in special):
            raise ValueError("special tokens are taken to start with <| and hold no white space")
        letters = _byte_letters()
        vocab = {t: i for t, i in spec["model"]["vocab"].items() if t not in special}
        ranks = {
            bytes(letters[c] for c in t.removesuffix("</w>")) + b" " * t.endswith("</w>"): i
            for t, i in vocab.items()
        }
        self.merger = tiktoken.Encoding("words", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={})
        self.size = max(self.tokenizer.get_vocab().values()) + 1
        self.closes = np.zeros(self.size, bool)
        self.closes[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self._clear()

    def _clear(self) -> None:
        places = 1 << SLOT_BITS
        self.first, self.second = np.zeros(places, np.uint64), np.zeros(places, np.uint64)
        self.bytes_in = np.zeros(places, np.uint8)  # 0: a free place
        self.at, self.n = np.zeros(places, np.int32), np.zeros(places, np.uint8)
        self.pool, self.used = np.zeros(1 << 16, np.int32), 0

    def _add(self, ids: np.ndarray) -> int:
        """Append ids to the pool; the place where they begin."""
        begin, self.used = self.used, self.used + len(ids)
        if self.used > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros(max(self.used, len(self.pool)), np.int32)])
        self.pool[begin : self.used] = ids
        return begin

    def _whole(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)

    def _merged(self, spaced: str, pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """(ids, ids of each word) of words given as pieces closed by spaces; none if the merger sees other pieces."""
        ids = self.merger.encode_to_numpy(spaced).astype(np.int32)
        ends = np.flatnonzero(self.closes[ids]) + 1
        last = np.cumsum(pieces)
        if len(ends) != last[-1]:
            return None
        return ids, np.diff(ends[last - 1], prepend=0)

    def _learn(self, padded: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of each word of the bytes."""
        sizes = ends - starts + 1
        joined = padded[_ranges(starts, sizes)]
        joined[np.cumsum(sizes) - 1] = 32
        text = joined.tobytes().decode()
        chars = np.frombuffer(text.encode("utf-32-le"), "<u4")
        gaps = np.flatnonzero(chars == 32)
        begins = np.concatenate([[0], gaps[:-1] + 1])
        at, n = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)

        def place(which: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
            n[which] = counts
            at[which] = self._add(ids) + np.cumsum(counts) - counts

        hard, quoted = np.zeros(len(starts), bool), np.zeros(len(starts), bool)
        far = (chars >= FAR) | (chars == DOTTED)
        far[:-1] |= (chars[:-1] == ord("<")) & (chars[1:] == ord("|"))
        hard[np.searchsorted(gaps, np.flatnonzero(far))] = True
        quoted[np.searchsorted(gaps, np.flatnonzero(chars == ord("'")))] = True
        quoted &= ~hard
        easy = np.flatnonzero(~hard & ~quoted)
        if len(easy):
            mine = chars
            if len(easy) < len(starts):
                mine = chars[_ranges(begins[easy], gaps[easy] - begins[easy] + 1)]
            kind = np.where(mine == 32, 0, _KIND[mine])
            cut = np.zeros(len(mine), bool)
            cut[1:] = (kind[1:] > 0) & (kind[:-1] > 0) & ((kind[1:] != kind[:-1]) | (kind[1:] == 2))
            spaced = np.insert(_LOWER[mine], np.flatnonzero(cut), 32).astype("<u4").tobytes().decode("utf-32-le")
            pieces = np.add.reduceat(cut, np.concatenate([[0], np.flatnonzero(mine == 32)[:-1] + 1]), dtype=np.int64) + 1
            found = self._merged(spaced, pieces)
            if found is None:
                hard[easy] = True
            else:
                place(easy, *found)
        some = np.flatnonzero(quoted)
        if len(some):
            cuts = [_PIECE.findall(text[b:e].lower()) for b, e in zip(begins[some].tolist(), gaps[some].tolist(), strict=True)]
            found = self._merged("".join(f"{p} " for c in cuts for p in c), np.array([len(c) for c in cuts]))
            if found is None:
                hard[some] = True
            else:
                place(some, *found)
        for k in np.flatnonzero(hard).tolist():
            ids = self._whole(text[begins[k] : gaps[k]])
            place(np.array([k]), ids, np.array([len(ids)]))
        return at, n

    def _located(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the pool, number of ids) of each word, from the table or learned."""
        if self.used > KEPT_IDS:
            self._clear()
        padded = np.concatenate([buf, np.zeros(SHORT, np.uint8)])
        loads = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
        sizes = ends - starts
        first = loads[starts] & _MASK[np.minimum(sizes, 8)]
        second = loads[starts + 8] & _MASK[np.clip(sizes - 8, 0, 8)]
        with np.errstate(over="ignore"):
            code = texthash.mix(first ^ texthash.mix(second + sizes.astype(np.uint64)))
        slot = (code >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        known = (self.bytes_in[slot] == sizes) & (self.first[slot] == first) & (self.second[slot] == second)
        at, n = self.at[slot].astype(np.int64), self.n[slot].astype(np.int64)
        fresh = np.flatnonzero(~known & (sizes <= SHORT))
        fresh = fresh[np.argsort(code[fresh], kind="stable")]
        alike = np.ones(len(fresh), bool)
        for column in (code, first, second, sizes):
            alike[1:] &= column[fresh[1:]] == column[fresh[:-1]]
        alike[:1] = False
        one = fresh[~alike]
        long: dict[bytes, list[int]] = {}
        for k in np.flatnonzero(sizes > SHORT).tolist():
            long.setdefault(buf[starts[k] : ends[k]].tobytes(), []).append(k)
        asked = np.concatenate([one, np.array([k[0] for k in long.values()], np.int64)])
        if not len(asked):
            return at, n
        found_at, found_n = self._learn(padded, starts[asked], ends[asked])
        of = np.cumsum(~alike) - 1
        at[fresh], n[fresh] = found_at[of], found_n[of]
        for where, a, c in zip(long.values(), found_at[len(one) :].tolist(), found_n[len(one) :].tolist(), strict=True):
            at[where], n[where] = a, c
        keep = one[n[one] < 256]
        here = slot[keep]
        self.first[here], self.second[here], self.bytes_in[here] = first[keep], second[keep], sizes[keep]
        self.at[here], self.n[here] = at[keep], n[keep]
        return at, n

    def _texts(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, dict[int, np.ndarray]]]:
        """For each chunk of rows: places and numbers of ids of all words, words before each row, ids of odd rows."""
        for row, end, buf, offs in texthash.chunks(texts, fold=False):
            starts, ends, before = texthash.spans(buf, offs, texthash.NOT_SPACE)
            odd = {}
            leads = np.flatnonzero(_ODD_LEAD[buf])
            for k in np.unique(np.searchsorted(offs, leads, "right") - 1).tolist():
                raw = buf[offs[k] : offs[k + 1]].tobytes()
                if _ODD.search(raw):
                    odd[k] = self._whole(raw.decode())
            if odd:
                plain = np.ones(end - row, bool)
                plain[list(odd)] = False
                words = np.diff(before)
                kept = np.repeat(plain, words)
                starts, ends = starts[kept], ends[kept]
                before = np.concatenate([[0], np.cumsum(np.where(plain, words, 0))])
            at, n = self._located(buf, starts, ends)
            yield at, n, before, odd

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows end to end, where each row's ids begin, with the end of the last)."""
        parts, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        for at, n, before, odd in self._texts(texts):
            ids = self.pool[_ranges(at, n)]
            upto = np.concatenate([[0], np.cumsum(n)])[before]
            sizes = np.diff(upto)
            if odd:
                ids = np.concatenate([odd.get(k, ids[a:b]) for k, (a, b) in enumerate(zip(upto[:-1].tolist(), upto[1:].tolist(), strict=True))])
                sizes[list(odd)] = [len(x) for x in odd.values()]
            parts.append(ids)
            counts.append(sizes)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of each row."""
        counts = [np.zeros(0, np.int64)]
        for _, n, before, odd in self._texts(texts):
            sizes = np.diff(np.concatenate([[0], np.cumsum(n)])[before])
            if odd:
                sizes[list(odd)] = [len(x) for x in odd.values()]
            counts.append(sizes)
        return np.concatenate(counts)

    def ids(self, text: str | None) -> np.ndarray:
        return self.encode(pa.array([text], pa.string()))[0]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder for each Python worker and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
