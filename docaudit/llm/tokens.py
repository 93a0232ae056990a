"""Token ids of many texts by a byte-level BPE, each distinct piece of text encoded once.

The pattern before the merges splits texts into pieces that are encoded independently. Where a slice holds only
letters, ASCII digits, marks and white space, numpy finds the same pieces from byte classes; other texts go through
the tokenizer whole. Pieces' ids are kept for each Python worker up to a bound.
"""

from __future__ import annotations

import itertools
import unicodedata

import numpy as np

from docaudit.llm import batches, words

#: Pieces a worker remembers before it starts over.
KNOWN_PIECES = 200_000
#: Bytes beyond which a text is cut for the sentencepiece model.
WHOLE = 1 << 16
#: Byte classes: 0 white space, 1 letter, 2 digit, 3 other, 4 left to the tokenizer.
CLASS = np.full(256, 3, np.uint8)
CLASS[[0x20, *range(0x09, 0x0E)]] = 0
CLASS[[b for b in range(256) if b >= 0x80 or chr(b).isalpha()]] = 1
CLASS[ord("0") : ord("9") + 1] = 2
CLASS[[*range(0x1C, 0x20), ord("'")]] = 4


def _byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabulary: itself, or the next free one from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) if b in plain else chr(0x100 + rest.index(b)) for b in range(256)}


class Encoder:
    """With plain, the strings of added tokens inside texts are ordinary text."""

    def __init__(self, path: str, plain: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        #: Tokens that the tokenizer cuts out before its pattern; texts that hold one go through it whole.
        self.added = [] if plain else [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.forget()

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id; an added token's are its own string's."""
        back = {ord(c): b for b, c in self.letters.items()}
        found = [b""] * self.tokenizer.get_vocab_size()
        for token, k in self.tokenizer.get_vocab().items():
            found[k] = bytes(back[ord(c)] for c in token) if all(ord(c) in back for c in token) else token.encode()
        return found

    def forget(self) -> None:
        self.places: dict[bytes, int] = {}
        self.starts, self.sizes = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.int32), 0

    def _learn(self, pieces: list[bytes]) -> None:
        merge = self.tokenizer.model.tokenize
        for piece in pieces:
            own, k = [x.id for x in merge(piece.decode("latin-1").translate(self.letters))], len(self.places)
            if k == len(self.starts):
                self.starts, self.sizes = np.r_[self.starts, self.starts * 0], np.r_[self.sizes, self.sizes * 0]
            while self.used + len(own) > len(self.ids):
                self.ids = np.r_[self.ids, self.ids * 0]
            self.ids[self.used : self.used + len(own)] = own
            self.starts[k], self.sizes[k] = self.used, len(own)
            self.places[piece] = k
            self.used += len(own)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text behind the other, and where each text's begin (one more at the end)."""
        odd = np.add.reduceat(np.r_[CLASS[data] == 4, False], np.minimum(offsets[:-1], len(data))) > 0 if len(offsets) > 1 else np.zeros(0, bool)
        odd &= offsets[1:] > offsets[:-1]
        raw = data.tobytes()
        for token in self.added:
            at = raw.find(token)
            while at >= 0:
                odd[np.searchsorted(offsets, at, "right") - 1] = True
                at = raw.find(token, at + 1)
        if (data >= 0x80).any():
            text = raw.decode("utf-8", "replace")
            strange = [c for c in set(text) if ord(c) >= 0x80 and unicodedata.category(c)[0] != "L"]
            if strange:
                odd |= np.array([any(c in x for c in strange) for x in (data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:]))], bool)
        if not odd.any():
            return self._encode_plain(data, offsets)
        plain = np.flatnonzero(~odd)
        sizes = np.diff(offsets)[plain]
        rest = data[words.ranges(offsets[plain], sizes)] if len(plain) else data[:0]
        ids, at = self._encode_plain(rest, np.r_[0, np.cumsum(sizes)].astype(np.int64))
        own = {int(k): ids[at[i] : at[i + 1]] for i, k in enumerate(plain)}
        strange = np.flatnonzero(odd).tolist()
        for k, made in zip(strange, self.tokenizer.encode_batch_fast([data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace") for k in strange], add_special_tokens=False)):
            own[k] = np.array(made.ids, np.int32)
        parts = [own[k] for k in range(len(offsets) - 1)]
        return np.concatenate(parts), np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)

    def _encode_plain(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        kind = CLASS[data]
        head = np.zeros(len(data) + 1, bool)
        head[offsets] = True
        start = np.ones(len(data), bool)
        start[1:] = kind[1:] != kind[:-1]
        start |= head[:-1]
        # Before a text's next word, a run of white space gives up its last character: a blank joins the word.
        last = np.flatnonzero((kind[:-1] == 0) & (kind[1:] != 0) & ~head[1:-1])
        start[last] = True
        start[last[data[last] == 0x20] + 1] = False
        at = np.flatnonzero(start)
        to = np.r_[at[1:], len(data)]
        _, index, inverse = np.unique(words.hash_spans(words.padded(data), at, to), return_index=True, return_inverse=True)
        if len(self.places) > KNOWN_PIECES or self.used > 8 * KNOWN_PIECES:
            self.forget()
        raw = data.tobytes()
        found = [raw[at[i] : to[i]] for i in index.tolist()]
        self._learn([x for x in found if x not in self.places])
        place = np.fromiter((self.places[x] for x in found), np.int64, len(found))[inverse]
        sizes = self.sizes[place]
        ids = self.ids[words.ranges(self.starts[place], sizes)]
        total = np.r_[0, np.cumsum(sizes)]
        return ids, total[np.searchsorted(at, offsets)]


class PieceEncoder:
    """A sentencepiece BPE over texts that begin with the blank it would add.

    No piece of the vocabulary has a blank behind another character, so merges never cross the start of a run of
    blanks: there long texts are cut, and the merges' memory depends on the longest stretch without a blank alone.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        if any("\u2581" in x.lstrip("\u2581") for x in self.names):
            raise ValueError("pieces of this vocabulary cross blanks")

    def token_bytes(self) -> list[bytes]:
        """The bytes of every id, U+2581 as a blank and <0xHH> as the byte HH."""
        return [bytes([int(x[3:5], 16)]) if self.model.is_byte(k) else x.replace("\u2581", " ").encode() for k, x in enumerate(self.names)]

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, one text behind the other, and where each text's begin (one more at the end).

        Each text is empty or begins with a blank. One with U+2581 of its own may be cut elsewhere than the model would.
        """
        raw, parts, firsts = data.tobytes(), [], [0]
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            while a < b:
                to = raw.find(b" ", min(a + WHOLE, b), b) if b - a > WHOLE else b
                while 0 < to < b and raw[to - 1] == 0x20:  # not within a run
                    to = raw.find(b" ", to + 1, b)
                to = b if to < 0 or to == b - 1 else to  # a blank alone is nothing to the model
                parts.append(raw[a + 1 : to].decode("utf-8", "replace"))
                a = to
            firsts.append(len(parts))
        found = self.model.encode(parts, num_threads=1) if parts else []
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))
        return ids, np.r_[0, np.cumsum(sizes)][np.array(firsts)].astype(np.int64)


@batches.cached
def encoder(path: str, plain: bool = False) -> Encoder:
    return Encoder(path, plain)


@batches.cached
def piece_encoder(path: str) -> PieceEncoder:
    return PieceEncoder(path)
