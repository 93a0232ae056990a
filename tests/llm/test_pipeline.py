"""The whole pipeline against a plain version of each stage on a small table."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from docaudit.llm import contamination, language, line_chunks

from . import cases

ENGLISH = "the of and to in that is was for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through back years where much your way well down should because each just those people mr how too little state good very make world still own see men work long get here between both life being under never day same another know while last might us great old year off come since against go came right used take three".split()
GERMAN = "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur oder aber vor zur bis mehr durch man sein wurde sei prozent hatte kann gegen vom können schon wenn habe seine mark ihre dann unter wir soll ich eines jahr zwei jahren diese dieser wieder keine uhr seiner worden will zwischen immer millionen was sagte".split()
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"


def table() -> list[tuple]:
    r = random.Random(8)
    rows: list[tuple] = []

    def prose(words, n, width=14):
        made = [r.choice(words) for _ in range(n)]
        return "\n".join(" ".join(made[k : k + width]) for k in range(0, n, width))

    for k in range(40):
        words, lang = (ENGLISH, "en") if k % 2 else (GERMAN, "de")
        rows.append((k, prose(words, r.randint(40, 200)), lang if k % 5 else None))
    base = prose(ENGLISH, 160, width=160)
    rows += [(100, base, "en"), (101, base, "en"), (102, base + " and one more", "en"), (103, base.replace(" ", "  ", 3), "en")]
    rows.append((104, " ".join(base.split()[:100]) + " " + prose(ENGLISH, 60, width=60), "en"))
    shared = "\n".join(prose(GERMAN, 12, width=12) for _ in range(4))
    rows += [(110 + k, f"{prose(GERMAN, 30, width=30)}\n{shared}\n{prose(GERMAN, 30, width=30)}", "de") for k in range(3)]
    rows.append((120, prose(ENGLISH, 60, width=60) + f" {ITEM} " + prose(ENGLISH, 60, width=60), "en"))
    rows.append((121, f"so {ITEM} and", "en"))
    rows += [(130, None, "en"), (131, "", "en"), (132, "123 456 !!", "en"), (None, prose(ENGLISH, 80), None), (133, prose(ENGLISH, 6000, width=6000), "en"), (134, "the old man", "en"), (134, "the old man", "en")]
    return rows


def parsed(text: str, known: str) -> int:
    """Phrases of a text, each the longest that the known text holds."""
    symbols = language.letters(text)
    parts, at = (1 if symbols else 0), 0
    while at < len(symbols):
        n = 1
        while at + n <= len(symbols) and symbols[at : at + n] in known:
            n += 1
        n -= 1
        if at + n >= len(symbols):
            break
        # A letter that the language lacks ends a phrase, and the next begins behind it.
        if symbols[at + n] not in known:
            n += 1
        parts, at = parts + 1, at + n
    return parts


def by_language(rows, texts):
    for d, t, lang in rows:
        if t and any(c.isalpha() for c in t):
            counts = {k: parsed(t, language.letters(x)) for k, x in texts.items()}
            best = min(counts, key=lambda k: counts[k])
            # A text may begin with a gap, which letters() drops.
            gap = not t[0].isalpha()
            if not gap and (counts[best] - 1) / max(1, len(language.letters(t))) <= language.WORST_RATE:
                yield d, t, lang or best


def without_lines(rows):
    seen: set = set()
    for d, t, lang in sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0)):
        lines, gone = re.split(line_chunks.UNIT_END, t), set()
        for i in range(len(lines) - 1):
            two = (lines[i], lines[i + 1])
            if (two[0] + two[1]).strip() and two in seen:
                gone |= {i, i + 1}
        seen |= {(a, b) for a, b in zip(lines, lines[1:])}
        left = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or left.strip():
            yield d, left, lang


def one_of_each(rows):
    def grams(t):
        w = t.lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or {tuple(w)}

    # Equal rows count once.
    rows = [x for k, x in enumerate(rows) if x[:2] not in [y[:2] for y in rows[:k]]]
    sets, group = [grams(t) for _, t, _ in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                group = [group[j] if g == group[i] else g for g in group]
    for g in set(group):
        own = [rows[k] for k in range(len(rows)) if group[k] == g]
        ids = [d for d, _, _ in own if d is not None]
        least = min(ids) if ids else None
        yield next(x for x in own if x[0] == least)


def without_items(rows):
    item = ITEM.split()
    windows = {tuple(item[k : k + 10]) for k in range(len(item) - 9)}
    for d, t, lang in rows:
        spots = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())]
        w = [t.lower()[a:b] for a, b in spots]
        hit = {x for k in range(len(w) - 9) if tuple(w[k : k + 10]) in windows for x in range(k, k + 10)}
        if len(hit) < contamination.MOSTLY * len(w) or not hit:
            kept, at = "", 0
            for a in sorted(k for k in hit if k - 1 not in hit):
                b = next(k for k in range(a, len(w) + 1) if k not in hit) - 1
                kept, at = kept + t[at : spots[a][0]], spots[b][1]
            yield d, kept + t[at:], lang


def test_the_pipeline_equals_plain_stages(spark, tmp_path):
    rows = table()
    docs = spark.createDataFrame([(d, t, lang, "src", len(t or "")) for d, t, lang in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("b1", ITEM)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    want = list(without_items(list(one_of_each(list(without_lines(list(by_language(rows, language.train(docs)))))))))
    assert 40 < len(want) < len(rows) - 6
    found = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces = []
    for d, t, _ in want:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 0], "<u4")
        cuts = [0, *range(len(ids) % 2048 or 2048, len(ids) + 1, 2048)]
        pieces += [(d, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found), key=str) == sorted(pieces, key=str)
    filled: dict = {}
    for r in sorted(found, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == filled.get(r.sequence_id, 0)
        filled[r.sequence_id] = r.offset + r.length
    assert max(filled.values()) <= 2048 and len(filled) <= -(-sum(p[3] for p in pieces) // 2048) + 1


def test_stages_return_the_columns_of_documents(spark, tmp_path):
    spark.createDataFrame([("b1", ITEM)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (cases.documents(spark), cases.empty(spark)):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            made = stage(spark, docs, str(tmp_path))
            assert made.columns == docs.columns, name
            assert made.count() <= docs.count()
