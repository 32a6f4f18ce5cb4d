"""Token ids of whole texts by the ``tokenizers`` library, with a memo of short pieces.

A byte-pair tokenizer of the kinds used here splits a text into words first.
No word reaches across the point where white space follows other text, nor
where a full stop or comma follows a letter or digit.  Texts are cut at those
points, each distinct piece is encoded by the library once and kept in a
bounded memo, and the ids are joined.  A text with white space other than the
four usual characters, or with an added token of the tokenizer (such as
``<|endoftext|>``) in it, is encoded as a whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from siltstone.llm._runtime import used

_PIECE = re.compile(r"[ \n\t\r]*(?:[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+(?=[.,;:!? \n\t\r])|[^ \n\t\r]+)|[ \n\t\r]+")
#: White space beyond the usual four, and controls that some libraries count as such.
_UNUSUAL = re.compile("[\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2060\u3000\ufeff]")
#: A space, letters and marks: what follows it in a text, if led by a space too, is split from it by a byte-level tokenizer.
_LED = re.compile(r" [A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+[.,;:!?]*")
#: A space, letters, ASCII marks or none but for the apostrophe: a byte-level tokenizer splits such a piece before the marks and nowhere else.
_WORD = re.compile(r"( [A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f]+)([!-&(-/:-@\[-`{-~]*)")
#: Longer pieces are encoded but not kept.
PIECE_CHARS = 48
MEMO_ENTRIES = 600_000
#: Bytes of text encoded at a time; a longer text is encoded alone.
SLICE_BYTES = 4 << 20
#: New words encoded in one call.
WORDS_A_CALL = 512
#: MB of text after which freed memory goes back to the system.
TRIM_MB = 12


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_names() -> dict[int, str]:
    """The letters of _WORD and the space as a byte-level vocabulary writes them: a character for each byte of UTF-8."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    names = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}
    return {c: "".join(names[b] for b in chr(c).encode()) for c in (0x20, *range(0xC0, 0x250))}


_BYTE_NAMES = _byte_names()


class Encoder:
    """``encode(texts)`` gives each text's ids as bytes of little-endian unsigned 32-bit numbers: those of the library without special tokens added."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = [t["content"] for t in json.loads(self.tokenizer.to_str())["added_tokens"]]
        self.lead = os.path.commonprefix(added)
        self.added = re.compile("|".join(map(re.escape, added))) if added else None
        tokens = {i: t for t, i in self.tokenizer.get_vocab().items()}
        names = [tokens.get(i, "") for i in range(max(tokens, default=-1) + 1)]
        parts = json.loads(self.tokenizer.to_str())
        suffix, split = parts["model"].get("end_of_word_suffix"), parts["pre_tokenizer"] or {}
        #: Whether pieces of the form of _WORD go to the library's model as they are, without its splitting.
        self.by_model = parts["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        self.ends_word = np.array([t.endswith(suffix) for t in names]) if suffix else None
        self.n_bytes = np.array([len(t) for t in names])  # a character of a byte-level vocabulary is a byte
        self.memo: dict[str, bytes] = {}
        self.memo_entries = memo_entries

    def _library(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, pieces: list[str]) -> list[bytes]:
        """Ids of pieces that are a space and letters each, in byte-level vocabularies marks too, many to a call.

        Where a vocabulary marks ends of words, those tokens tell where the
        ids of a piece end; else the bytes that tokens stand for do.
        """
        out: list[bytes] = []
        for at in range(0, len(pieces), WORDS_A_CALL):
            part = pieces[at : at + WORDS_A_CALL]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, dtype="<u4")
            if self.ends_word is not None:
                ends = np.flatnonzero(self.ends_word[ids]) + 1
            else:
                reach, wanted = np.cumsum(self.n_bytes[ids]), np.cumsum([len(p.encode()) for p in part])
                ends = np.searchsorted(reach, wanted) + 1
                ends = ends if ends[-1] <= len(ids) and (reach[ends - 1] == wanted).all() else ends[:0]
            if len(ends) != len(part):
                out += self._library(part)
                continue
            raw, first = ids.tobytes(), 0
            for end in (ends * 4).tolist():
                out.append(raw[first:end])
                first = end
        return out

    def _by_model(self, names: list[str]) -> tuple[dict[str, bytes], list[str]]:
        """Ids of those pieces that have the form of _WORD, and the other pieces: the library's model encodes the word and the marks."""
        tokenize, match, flat = self.tokenizer.model.tokenize, _WORD.fullmatch, array("I")
        some, reach, other, marks = [], [0], [], {"": []}
        for p in names:
            found = match(p)
            if found is None:
                other.append(p)
                continue
            word, end = found.groups()
            if not word.isascii():
                word = word.translate(_BYTE_NAMES)
            else:
                word = "\u0120" + word[1:]
            if end not in marks:
                marks[end] = [t.id for t in tokenize(end)]
            flat.extend([t.id for t in tokenize(word)] + marks[end])
            some.append(p)
            reach.append(len(flat) * 4)
        raw = flat.tobytes()
        return dict(zip(some, [raw[x:y] for x, y in zip(reach, reach[1:], strict=False)], strict=True)), other

    def _lookup(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pieces, from the memo or else the library."""
        memo = self.memo
        if len(memo) > self.memo_entries:  # what came first is what comes often
            memo = self.memo = dict(islice(memo.items(), self.memo_entries * 2 // 3))
        found = list(map(memo.get, pieces))
        gaps = [k for k, ids in enumerate(found) if ids is None]
        names = [pieces[k] for k in gaps]
        fresh, left = self._by_model(names) if self.by_model else ({}, names)
        plain = [p for p in left if p[:1] == " " and p[1:].isalpha()] if self.ends_word is not None else [p for p in left if _LED.fullmatch(p)]
        done = set(plain)
        other = [p for p in left if p not in done] if len(done) < len(left) else []
        fresh.update(zip(plain, self._words(plain), strict=True))
        fresh.update(zip(other, self._library(other), strict=True))
        for k, p in zip(gaps, names, strict=True):
            found[k] = fresh[p]
        memo.update(fresh)
        for p in names:
            if len(p) > PIECE_CHARS:
                del memo[p]
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Pieces of all texts are cut and made distinct column-wise; each distinct one is looked up once."""
        if not texts:
            return []
        used(sum(map(len, texts)), TRIM_MB)
        held = {k for k, t in enumerate(texts) if self.lead in t and self.added.search(t)} if self.added else set()
        regular = [True] * len(texts) if not held and _regular(texts) else [k not in held and _regular([t]) for k, t in enumerate(texts)]
        whole = [k for k, ok in enumerate(regular) if not ok and (k in held or _UNUSUAL.search(texts[k]))]
        out: dict[int, bytes] = dict(zip(whole, self._library([texts[k] for k in whole]), strict=True))
        some = [k for k, ok in enumerate(regular) if ok]
        marked = pa.array([texts[k] for k in some], pa.string())
        for at, cut in ((" ", "\x01 "), ("\n", "\x01\n\x01"), (",", "\x01,"), (".", "\x01.")):
            marked = pc.replace_substring(marked, at, cut)
        pieces = [pc.split_pattern(marked, "\x01")]
        rest = [k for k in range(len(texts)) if not regular[k] and k not in out]
        pieces.append(pa.array([_PIECE.findall(texts[k]) for k in rest], pa.list_(pa.string())))
        lists = pa.concat_arrays(pieces)
        named = lists.flatten().dictionary_encode()
        ids = self._lookup(strings(named.dictionary))
        index = named.indices.to_numpy()
        raw = pa.array(ids, pa.large_binary()).take(named.indices).buffers()[2]
        raw = raw.to_pybytes() if raw is not None else b""
        reach = np.r_[0, np.cumsum(np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))[index])]
        ends = reach[np.r_[0, np.cumsum(lists.value_lengths().to_numpy())]].tolist()
        for k, a, b in zip([*some, *rest], ends, ends[1:], strict=False):
            out[k] = raw[a:b]
        return [out[k] for k in range(len(texts))]


def strings(values: pa.Array) -> list[str]:
    """The strings of a column without nulls: split from one string, which takes a fraction of making them one by one."""
    if not len(values):
        return []
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values), "\x01")
    found = joined[0].as_py().split("\x01")
    return found if len(found) == len(values) else values.to_pylist()  # some hold the mark themselves


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """(first row, rows) of runs of a binary column of at most :data:`SLICE_BYTES` each."""
    at, held = 0, 0
    for k, n in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if held and held + n > SLICE_BYTES:
            yield at, k - at
            at, held = k, 0
        held += n
    if at < len(texts):
        yield at, len(texts) - at


#: What a byte may be, as bits: a space or line end, a tab or return, the first of a character of _UNUSUAL, a full stop or comma.
_BREAK, _OTHER_WHITE, _SUSPECT, _MARK = 1, 2, 4, 8
_KINDS = np.zeros(256, dtype=np.uint8)
_KINDS[[0x20, 0x0A]] = _BREAK
_KINDS[[0x09, 0x0D]] = _OTHER_WHITE
_KINDS[[0x0B, 0x0C, 0x1C, 0x1D, 0x1E, 0x1F, 0xC2, 0xE1, 0xE2, 0xE3, 0xEF]] = _SUSPECT
_KINDS[[ord("."), ord(",")]] = _MARK
#: ASCII letters and digits, by code.
_PLAIN = np.array([chr(c).isalnum() and c < 128 for c in range(256)])


def _regular(texts: list[str]) -> bool:
    """Whether all of ``texts`` may be cut at every space, line end, full stop and comma.

    So it is where white space comes as single spaces and line ends after
    something else, and full stops and commas only after ASCII letters and
    digits or the letters U+00C0 to U+024F.  Others are cut by a pattern.
    """
    joined = "\x01".join(texts)
    if joined.count("\x01") != len(texts) - 1:
        return False
    raw = np.frombuffer(("\x01\x01" + joined).encode(), dtype=np.uint8)
    kinds = _KINDS[raw]
    found = np.bitwise_or.reduce(kinds)
    if found & _OTHER_WHITE or (kinds[1:] & kinds[:-1] & _BREAK).any() or found & _SUSPECT and _UNUSUAL.search(joined):
        return False
    marks = np.flatnonzero(kinds == _MARK)
    last, lead = raw[marks - 1], raw[marks - 2]
    letter = (last >= 0x80) & (lead >= 0xC3) & (lead <= 0xC9) & ~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)))
    return bool((_PLAIN[last] | letter).all())


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """The process's encoder for a tokenizer file; Python workers keep it from task to task."""
    return Encoder(path)
