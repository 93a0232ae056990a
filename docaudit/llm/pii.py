"""Personal data: fixed patterns, and spans that a linear-chain conditional random field adds.

The field labels the white-space words of every line with a digit or a word that announces a value, from shapes of the
word and its neighbours. A word without a digit is part of a span only where such a word is itself, one of the two
before it or the next one in the line, so other lines need no decoding. It is trained on a small labelled table made from rules. What
it finds beside the patterns' spans is added; those stay.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from docaudit.llm import batches
from docaudit.llm.crf import Chain

KINDS = ("email", "ip", "card", "phone", "id", "secret", "name", "address")
#: A label with + goes on with the span before it.
LABELS = ("out", "phone", "phone+", "id", "secret", "name", "name+", "address", "address+")
#: Sequences of the labelled table, and the seed of its rule.
TRAINING_LINES = 1200
SEED = 7

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def emails(text: str) -> list[tuple[int, int]]:
    """Each @ with the name that ends before it and the domain behind it; one pass, whatever the text."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        domain = _DOMAIN.match(text, at + 1)
        if domain:
            begin = at
            while begin > free and text[begin - 1] in _LOCAL:
                begin -= 1
            if begin < at:
                out.append((begin, domain.end()))
                free = domain.end()
        at = text.find("@", at + 1)
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind and start; a failing match is dropped and its characters are used up."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    for m in _IP.finditer(text):
        if all(int(x[-4:]) <= 255 and len(x.lstrip("0")) <= 3 for x in m[0].split(".")):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


#: Words before a value that say what it is.
CUES = {
    "phone": {"tel", "phone", "call", "mobile", "fax", "cell", "tél", "telefon", "teléfono"},
    "id": {"ssn", "id", "passport", "iban", "nif", "dni", "insurance", "account", "ausweis"},
    "secret": {"password", "token", "secret", "key", "apikey", "api_key", "pwd", "passwd", "passphrase"},
    "name": {"name", "mr", "mrs", "ms", "dr", "frau", "herr", "mme", "señor", "señora", "patient", "customer"},
    "address": {"address", "adresse", "dirección", "street", "road", "avenue", "lane", "straße", "rue", "calle", "square"},
}
_CUE_WORDS = frozenset().union(*CUES.values())
_SHAPES = (
    ("digit", re.compile(r"[0-9]")),
    ("digits only", re.compile(r"[0-9]+\Z")),
    ("one or two", re.compile(r"\D*\d{1,2}\D*\Z")),
    ("area", re.compile(r"\(\d{2,5}\)\Z")),
    ("local", re.compile(r"\d{3,4}[-.]\d{3,4}\Z")),
    ("full", re.compile(r"\(?\d{3}\)?[-.]\d{3}[-.]\d{4}\Z")),
    ("three two four", re.compile(r"\d{3}-\d{2}-\d{4}\Z")),
    ("account", re.compile(r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}\Z")),
    ("letters in capitals and digits", re.compile(r"(?=.*\d)[A-Z0-9]{16,}\Z")),
    ("hexadecimal", re.compile(r"(?=.*\d)[0-9a-f]{16,}\Z")),
    ("assigned", re.compile(r"[A-Za-z_]+[=:]\"?\S{8,}\Z")),
    ("decimal", re.compile(r"\d+[.,:/]\d+\Z")),
    ("date", re.compile(r"\d{4}-\d{2}-\d{2}\Z")),
    ("letters and digits", re.compile(r"(?=.*\d)(?=.*[A-Za-z]).{1,15}\Z")),
    ("long", re.compile(r".{16,}\Z")),
    ("title", re.compile(r"(?:Mr|Mrs|Ms|Dr|Frau|Herr|Mme|Señora?)\Z")),
    ("letters alone", re.compile(r"[^\W\d_]+\Z")),
    ("capitalised", re.compile(r"[A-ZÀ-ÖØ-Þ][^\W\d_]*(?:-[A-ZÀ-ÖØ-Þ][^\W\d_]*)?\Z")),
    ("eight letters or more", re.compile(r"[^\W\d_]{8,}\Z")),
    ("sign", re.compile(r"[=:]\Z")),
)
_EDGES = ".,;:!?\"'()[]{}<>"


def _core(word: str) -> tuple[int, int]:
    """The word without marks at its edges; brackets around a part of a number stay."""
    a, b = 0, len(word)
    while b > a and word[b - 1] in ".,;:!?\"'[]{}<>":
        b -= 1
    while a < b and word[a] in ".,;:!?\"'[]{}<>":
        a += 1
    return a, b


@functools.lru_cache(1 << 17)
def _shape(word: str) -> tuple[int, ...]:
    a, b = _core(word)
    core = word[a:b]
    on = [k for k, (_, p) in enumerate(_SHAPES) if p.match(core) or (k == 0 and p.search(core))]
    name = re.split(r"[=:]", word.strip(_EDGES).lower())[0]
    on += [len(_SHAPES) + k for k, cue in enumerate(CUES.values()) if name in cue]
    if word[-1:] in ("=", ":"):
        on.append(len(_SHAPES) - 1)
    return tuple(sorted(set(on)))


WIDTH = len(_SHAPES) + len(CUES)


def features(lines: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """[words, 4 * WIDTH + 1]: shapes of the word, of the two before and of the one behind, and a constant."""
    offsets = np.r_[0, np.cumsum([len(x) for x in lines])].astype(np.int64)
    own = np.zeros((offsets[-1], WIDTH), np.float32)
    for k, w in enumerate(w for x in lines for w in x):
        own[k, list(_shape(w))] = 1
    parts = [own]
    place = np.arange(len(own)) - np.repeat(offsets[:-1], np.diff(offsets))
    behind = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(own)) - 1
    for step in (1, 2):
        moved = np.zeros_like(own)
        moved[step:] = own[:-step] if len(own) > step else own[:0]
        moved[place < step] = 0
        parts.append(moved)
    moved = np.zeros_like(own)
    moved[:-1] = own[1:]
    moved[behind < 1] = 0
    return np.hstack([*parts, moved, np.ones((len(own), 1), np.float32)]), offsets


def labelled_table(lines: int = TRAINING_LINES, seed: int = SEED) -> list[tuple[list[str], list[str]]]:
    """Words and labels of made-up lines: plain text and harmless numbers, with data of the kinds put in."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("aeinorst") for _ in range(r.randint(2, 9)))
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    harmless = (
        lambda: ["the", r.choice(sorted(_CUE_WORDS)), r.choice(("of", "is", "to", "must")), letters(r.randint(2, 12))], lambda: [r.choice(("call", "key", "name", "street", "token")), word()],
        lambda: ["the", r.choice(("street", "road", "name", "password")), word(), digits(2), word()], lambda: [word().capitalize(), word().capitalize()], lambda: [digits(2), word().capitalize(), word()],
        lambda: ["key:", r.choice(("see", "the", "a")), word(), word()], lambda: ["name", "and", word() + ":", word().capitalize()],
        lambda: [digits(r.randint(1, 4))], lambda: [f"{digits(1)}.{digits(1)}"], lambda: ["version", digits(1) + "."], lambda: [f"{digits(2)}:{digits(2)}"],
        lambda: [f"20{digits(2)}-0{r.randint(1, 9)}-1{r.randint(0, 9)}"], lambda: [f"{digits(2)},{digits(3)}"], lambda: [word() + digits(1)], lambda: ["$" + digits(3)],
        lambda: [f"({digits(1)})"], lambda: [digits(6)], lambda: [f"{word()}.{digits(2)}@{word()}.example.com"], lambda: [".".join(digits(2) for _ in range(4))], lambda: [digits(16)],
    )
    data = (
        lambda: ([f"({digits(3)})", f"{digits(3)}-{digits(4)}"], ["phone", "phone+"]),
        lambda: ([f"{digits(3)}-{digits(3)}-{digits(4)}"], ["phone"]),
        lambda: ([f"{r.choice(sorted(CUES['phone']))}:", f"{digits(4)}-{digits(4)}"], ["out", "phone"]),
        lambda: ([f"{digits(3)}-{digits(2)}-{digits(4)}"], ["id"]),
        lambda: ([r.choice(sorted(CUES["id"])) + ":", digits(9)], ["out", "id"]),
        lambda: ([f"{r.choice(('DE', 'FR', 'ES', 'GB'))}{digits(20)}"], ["id"]),
        lambda: ([r.choice(sorted(CUES["secret"])) + "=" + "".join(r.choice("0123456789abcdef") for _ in range(18))], ["secret"]),
        lambda: ([r.choice(sorted(CUES["secret"])), "=", '"' + "".join(r.choice("0123456789abcdef") for _ in range(32)) + '"'], ["out", "out", "secret"]),
        lambda: ([r.choice(sorted(CUES["secret"])) + r.choice("=:") + letters(r.randint(8, 24))], ["secret"]),
        lambda: ([r.choice(sorted(CUES["secret"])) + r.choice(("=", ":")), letters(r.randint(8, 24))], ["out", "secret"]),
        lambda: ([r.choice(sorted(CUES["secret"])), "=", '"' + letters(r.randint(8, 24)) + '"'], ["out", "out", "secret"]),
        lambda: ([r.choice(("Name:", "name:", "Patient:", "Customer:")), letters(5).capitalize(), letters(7).capitalize()], ["out", "name", "name+"]),
        lambda: ([r.choice(("Mr.", "Mrs.", "Ms.", "Dr.", "Herr", "Frau", "Mme", "Señora")), letters(6).capitalize()], ["out", "name"]),
        lambda: ([r.choice(("Mr", "Dr.", "Frau")), letters(4).capitalize(), letters(8).capitalize()], ["out", "name", "name+"]),
        lambda: ([digits(r.randint(1, 3)), letters(6).capitalize(), r.choice(("Street", "Road", "Avenue", "Lane", "Square"))], ["address", "address+", "address+"]),
        lambda: ([r.choice(("Address:", "Adresse:")), digits(2), letters(7).capitalize(), "Street"], ["out", "address", "address+", "address+"]),
        lambda: ([r.choice(("Rue", "Calle")), letters(7).capitalize(), digits(2)], ["address", "address+", "address+"]),
        lambda: (["AKIA" + "".join(r.choice("ABCDEFGHJKLMN0123456789") for _ in range(15)) + digits(1)], ["secret"]),
    )
    out = []
    for _ in range(lines):
        words, labels = [], []
        for _ in range(r.randint(1, 5)):
            for _ in range(r.randint(0, 6)):
                words.append(r.choice((word(), word().capitalize(), word() + r.choice(",."))))
                labels.append("out")
            if r.random() < 0.5:
                made = r.choice(harmless)()
                words += made
                labels += ["out"] * len(made)
            else:
                made, own = r.choice(data)()
                made[-1] += r.choice(("", "", ".", ","))
                words += made
                labels += own
        out.append((words, labels))
    return out


@functools.cache
def model() -> Chain:
    table = labelled_table()
    x, offsets = features([w for w, _ in table])
    y = np.array([LABELS.index(b) for _, own in table for b in own])
    keep = np.diff(offsets) > 0
    return Chain(x.shape[1], len(LABELS)).fit(x.astype(np.float64), y, np.r_[0, offsets[1:][keep]], rounds=150)


_WORD = re.compile(r"\S+")
_DIGIT = re.compile(r"[0-9]")
_CUE = re.compile(r"(?i)(?<![^\W_])(?:" + "|".join(sorted(_CUE_WORDS)) + r")(?![^\W_])")


def added_spans(text: str, base: list[tuple[str, int, int]], chain: Chain) -> list[tuple[str, int, int]]:
    """Spans of the field that meet none of the base ones."""
    lines, places = [], []
    begin = 0
    for line in text.split("\n"):
        if _DIGIT.search(line) or _CUE.search(line):
            found = [(m[0], begin + m.start()) for m in _WORD.finditer(line)]
            if found:
                lines.append([w for w, _ in found])
                places += found
        begin += len(line) + 1
    if not lines:
        return []
    x, offsets = features(lines)
    emission = x @ chain.weights
    # Columns of cues among the word's own shapes, and those of the two words before it and the one behind.
    cue = np.r_[len(_SHAPES) : WIDTH]
    announced = x[:, np.r_[cue, cue + WIDTH, cue + 2 * WIDTH, cue + 3 * WIDTH]].any(1)
    emission[(x[:, 0] == 0) & ~announced, 1:] = -1e9
    labels = chain.viterbi(emission, offsets)
    out: list[tuple[str, int, int]] = []
    taken = sorted((a, b) for _, a, b in base)
    starts = set(offsets.tolist())
    for k in np.flatnonzero(labels).tolist():
        word, at = places[k]
        a, b = _core(word)
        label = LABELS[labels[k]]
        value = max(word.find("=", a, b), word.find(":", a, b)) + 1 if label == "secret" else 0
        a = max(a, value + (word[value : value + 1] in ('"', "'"))) if value else a
        if label[-1] == "+" and out and k not in starts and LABELS[labels[k - 1]].rstrip("+") == label[:-1] == out[-1][0]:
            out[-1] = (label[:-1], out[-1][1], at + b)
        else:
            out.append((label.rstrip("+"), at + a, at + b))
    # The greatest end of the base spans that begin before each, for spans that reach over others.
    begins = [a for a, _ in taken]
    reach = np.maximum.accumulate([b for _, b in taken]) if taken else np.zeros(0, np.int64)
    free = []
    for kind, a, b in out:
        k = bisect.bisect_left(begins, b)
        if a < b and not (k and reach[k - 1] > a):
            free.append((kind, a, b))
    return free


def written(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(set(spans), key=lambda s: (KINDS.index(s[0]), s[1], s[2])))


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts and digest of the base spans, and all spans as kind:start:end in code points, end exclusive.

    n_id, n_secret, n_name and n_address count spans of the field, n_spans all.

    Null and empty texts have none; repeated rows are each answered.
    """
    chain = docs.sparkSession.sparkContext.broadcast(model())

    def run(part, data, offsets):
        n, extra = np.zeros((len(offsets) - 1, 4), np.int64), np.zeros((len(offsets) - 1, len(KINDS) - 3), np.int64)
        digests, spans = [hashlib.sha256(b"").hexdigest()] * len(n), [""] * len(n)
        for k in range(len(n)):
            text = data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace")
            base = base_spans(text)
            for kind, _, _ in base:
                n[k, KINDS.index(kind)] += 1
            every = sorted(set(base + added_spans(text, base, chain.value)))
            for kind, _, _ in every:
                if KINDS.index(kind) >= 4:
                    extra[k, KINDS.index(kind) - 4] += 1
            extra[k, -1] = len(every)
            digests[k], spans[k] = hashlib.sha256(written(base).encode()).hexdigest(), written(every)
        return batches.record(
            doc_id=part.column(part.schema.get_field_index("doc_id")), n_email=pa.array(n[:, 0]), n_ip=pa.array(n[:, 1]), n_card=pa.array(n[:, 2]), n_phone=pa.array(n[:, 3]),
            base_sha256=pa.array(digests), spans=pa.array(spans), **{f"n_{c}": pa.array(extra[:, k]) for k, c in enumerate((*KINDS[4:], "spans"))},
        )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return batches.map_slices(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string, n_id bigint, n_secret bigint, n_name bigint, n_address bigint, n_spans bigint")
