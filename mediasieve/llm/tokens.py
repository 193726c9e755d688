"""Encode Arrow text columns with a tokenizer file, each distinct piece of text once.

Both kinds split a text where the library's own pre-tokenizer always splits, so
the ids equal those of the whole text:

* ``words``: white space is dropped and no piece crosses it, nor does one hold a letter or digit and a
  mark after it; cut at ASCII white space and before the marks of CUT. Where the library lower-cases,
  ASCII and Latin-1 pieces are looked up in lower case. Pieces of plain letters, which its normalizer and
  pre-tokenizer leave as they are, go to its model without those two steps.
* ``bytes``: a space followed by a letter, digit or printable mark opens a piece; cut before it.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import string
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MARK = "~"
CUT = r"([A-Za-z0-9À-ÖØ-öø-ÿ])([.,;:!?\"#$%&)*])"
LATIN = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
FOLDS, PLAIN = r"^[\x00-\x7fÀ-ÖØ-öø-ÿ]*$", r"^[a-zß-öø-ÿ]+$"
# of a tokenizer file whose pre-tokenizer takes letters in one run and whose normalizer leaves those of PLAIN alone
RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
BARE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
JOINED, LEARNED = 256, 8192      # words encoded as one text, pieces learned at once
MEMO_BYTES = 40 << 20           # about what one worker remembers pieces with
PIECE_BYTES = 100               # of one piece besides its letters and ids: its place, and that in the table for a look-up


def _bare(path: str) -> tuple[dict, str] | None:
    """(the tokenizer file without normalizer, words cut at spaces alone, the suffix that ends a word); None where PLAIN words could then differ."""
    with open(path, encoding="utf-8") as file:
        held = json.load(file)
    steps = (held.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
    split = {"type": "Split", "pattern": {"Regex": RUNS}, "behavior": "Removed", "invert": True}
    normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    suffix = held["model"].get("end_of_word_suffix")
    if steps != [split, BARE] or (held.get("normalizer") or {}).get("normalizers") != normal or held["model"]["type"] != "BPE" or not suffix:
        return None
    if held.get("post_processor") or any(re.search(PLAIN, token["content"]) for token in held["added_tokens"]):
        return None
    spaces = {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}
    return held | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [spaces, BARE]}}, suffix


def file_digest(path: str) -> str:
    """The version of a tokenizer: the digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()


class Encoder:
    """A tokenizer with a bounded memory of pieces; ``kind`` is ``words`` or ``bytes``."""

    def __init__(self, path: str, kind: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.kind = Tokenizer.from_file(path), kind
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        mark = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        # a mark of one id that no word without it has: no piece crosses white space
        self.mark = mark[0] if kind == "words" and len(mark) == 1 else None
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.cuts = kind == "words" and not any(re.search(CUT, token) for token in self.added)
        normalizer = self.tokenizer.normalizer
        lowers = lambda letters: kind == "words" and normalizer is not None and normalizer.normalize_str(letters) == letters.lower()
        self.lowers, self.lowers_latin = lowers(string.ascii_uppercase), lowers(string.ascii_uppercase + LATIN)
        bare = _bare(path) if kind == "words" and self.mark is not None else None
        self.bare = None
        if bare:
            self.bare = Tokenizer.from_str(json.dumps(bare[0]))
            vocabulary = self.tokenizer.get_vocab()
            self.closes = np.zeros(max(vocabulary.values()) + 1, bool)       # ids that end a word
            self.closes[[i for token, i in vocabulary.items() if token.endswith(bare[1])]] = True
        self._clear()

    @property
    def code(self) -> dict[str, int]:
        """The place of each piece held."""
        return {piece: i for i, piece in enumerate(self.pieces.to_pylist())}

    def _clear(self) -> None:
        self.pieces = pa.array([], pa.string())
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts, self.lengths, self.uses = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32)
        self.used = self.letters = 0

    def _held_bytes(self) -> int:
        return PIECE_BYTES * len(self.pieces) + self.letters + 4 * self.used

    def _forget(self) -> None:
        """Keep the half of the pieces that most batches held."""
        n, pieces = len(self.pieces), self.pieces
        starts, lengths, uses, ids = self.starts[:n], self.lengths[:n], self.uses[:n], self.ids
        stay = np.sort(np.argsort(-uses, kind="stable")[:n // 2])
        self._clear()
        spans = lengths[stay]
        flat = ids[np.repeat(starts[stay] - (np.cumsum(spans) - spans), spans) + np.arange(spans.sum())]
        self._store(pieces.take(pa.array(stay)), flat, spans)
        self.uses[:len(stay)] = uses[stay] // 2

    def _alone(self, pieces: list[str], tokenizer=None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, ids of each)."""
        found = [e.ids for e in (tokenizer or self.tokenizer).encode_batch_fast(pieces, add_special_tokens=False)]
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.uint32, int(lengths.sum())), lengths

    def _joined(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words without the mark: many make one text, set apart by the mark."""
        texts = [f" {MARK} ".join(words[at:at + JOINED]) + f" {MARK}" for at in range(0, len(words), JOINED)]
        flat, _ = self._alone(texts)
        ends = np.flatnonzero(flat == self.mark)
        return flat[flat != self.mark], np.diff(ends, prepend=-1) - 1

    def _plain(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same for words of plain letters: a word ends where an id does that closes one."""
        flat, _ = self._alone([" ".join(words[at:at + JOINED]) for at in range(0, len(words), JOINED)], self.bare)
        lengths = np.diff(np.flatnonzero(self.closes[flat]), prepend=-1)
        return (flat, lengths) if len(lengths) == len(words) and lengths.sum() == len(flat) else self._joined(words)

    def _store(self, pieces: pa.Array, flat: np.ndarray, lengths: np.ndarray) -> None:
        k, n = len(self.pieces), len(pieces)
        if len(lengths) != n:
            raise ValueError("the tokenizer does not keep words apart")
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while k + n > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
            self.lengths = np.concatenate([self.lengths, np.zeros_like(self.lengths)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.ids[self.used:self.used + len(flat)] = flat
        self.starts[k:k + n] = self.used + np.cumsum(lengths) - lengths
        self.lengths[k:k + n] = lengths
        self.pieces = pa.concat_arrays([self.pieces, pieces])
        self.used += len(flat)
        self.letters += pc.sum(pc.binary_length(pieces)).as_py() or 0

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """The places given to new pieces."""
        marked = pc.match_substring(pieces, MARK).to_numpy(zero_copy_only=False) if self.mark is not None else np.ones(len(pieces), bool)
        plain = pc.match_substring_regex(pieces, PLAIN).to_numpy(zero_copy_only=False) if self.bare is not None else np.zeros(len(pieces), bool)
        codes = np.zeros(len(pieces), np.int64)
        for chosen, encoded in ((plain, self._plain), (~plain & ~marked, self._joined), (~plain & marked, self._alone)):
            where, found = np.flatnonzero(chosen), []
            codes[where] = len(self.pieces) + np.arange(len(where))
            kind = pieces.take(pa.array(where))
            for at in range(0, len(where), LEARNED):
                found.append(encoded(kind.slice(at, LEARNED).to_numpy(zero_copy_only=False).tolist()))
            if found:
                self._store(kind, *map(np.concatenate, zip(*found)))
        return codes

    def _split(self, texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """(pieces before each text and in all, pieces)."""
        if self.kind == "words":
            lists = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, CUT, r"\1 \2") if self.cuts else texts)
        else:
            if pc.any(pc.match_substring(texts, "\x00")).as_py():   # the mark itself occurs: whole texts
                return np.arange(len(texts) + 1), texts
            marked = pc.replace_substring_regex(texts, r" ([\p{L}\p{N}\x21-\x7e])", "\x00 \\1")
            lists = pc.split_pattern(marked, "\x00")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.cumsum(counts)]).astype(np.int64), pc.list_flatten(lists)

    def _folded(self, pieces: pa.Array) -> pa.Array:
        """ASCII and Latin-1 pieces in lower case, but for those that would then hold an added token."""
        lower = pc.utf8_lower(pieces) if self.lowers_latin else pc.ascii_lower(pieces)
        plain = pc.match_substring_regex(pieces, FOLDS) if self.lowers_latin else pc.string_is_ascii(pieces)
        for token in self.added:
            plain = pc.and_not(plain, pc.match_substring(lower, token))
        return pc.if_else(plain, lower, pieces)

    def _codes(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        bounds, pieces = self._split(texts)
        coded = pieces.dictionary_encode()
        indices, dictionary = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary
        if self.lowers:
            coded = self._folded(dictionary).dictionary_encode()
            indices, dictionary = coded.indices.to_numpy(zero_copy_only=False)[indices], coded.dictionary
        if self._held_bytes() > MEMO_BYTES:
            self._forget()
        dictionary = dictionary.cast(pa.string())
        codes = pc.fill_null(pc.index_in(dictionary, value_set=self.pieces), -1).to_numpy(zero_copy_only=False).astype(np.int64)
        missing = np.flatnonzero(codes < 0)
        codes[missing] = self._learn(dictionary.take(pa.array(missing)))
        self.uses[codes] += 1
        return bounds, codes[indices]

    def counts(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text (null: none)."""
        bounds, codes = self._codes(pc.fill_null(texts, ""))
        sums = np.concatenate([[0], np.cumsum(self.lengths[codes])])
        return sums[bounds[1:]] - sums[bounds[:-1]]

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, bounds of each); ``end_id`` closes each text."""
        bounds, codes = self._codes(pc.fill_null(texts, ""))
        lengths = self.lengths[codes]
        ends = np.cumsum(lengths)
        flat = self.ids[np.repeat(self.starts[codes] - (ends - lengths), lengths) + np.arange(lengths.sum())]
        at = np.concatenate([[0], ends])[bounds]
        if end_id is None:
            return flat, at
        return np.insert(flat, at[1:], np.uint32(end_id)), at + np.arange(len(at))


@lru_cache(maxsize=2)
def shared_encoder(path: str, kind: str) -> Encoder:
    """The encoder of a worker process: its memory of pieces lasts over groups and tasks."""
    return Encoder(path, kind)
