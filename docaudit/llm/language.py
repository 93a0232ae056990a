"""Language ID by cross-parsing entropy.

For each language a suffix automaton of its labelled text knows every substring of that text. A document is parsed
into phrases, each the longest match of the automaton from where the last one ended; the language that needs the
fewest phrases per letter wins. The training sample is a bounded number of whole rows; parsing covers whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.llm import batches
from docaudit.session import checkpointed, scratch

#: Bounds of the training sample: rows for each language; longer rows than this, in bytes, are taken only where a
#: language has no others, and then one. An automaton takes about 50 bytes a letter, in the broadcast and each worker.
ROWS_PER_LANGUAGE = 16
ROW_BYTES = 4096
#: Languages whose automata a task holds at once; more are parsed in blocks, one pass over the documents each.
LANGUAGES_AT_ONCE = 8
#: So many code points of a text are parsed side by side with the rest of it; results do not depend on it.
LANE = 1024
#: Documents with more phrases per letter than this in the best language are in none of the learned ones.
WORST_RATE = 0.55
#: Bytes of text parsed at once.
SLICE_BYTES = 1 << 20

COLUMNS = ("lang_pred", "score", "phrase_rate")
SCHEMA = "lang_pred string, score double, phrase_rate double"


def bucket(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null ids count as 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % parts, F.lit(0))


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """The edges of each state of the automaton that reads all substrings, from state 0."""
    following, link, length = [{}], [-1], [0]
    last = 0
    for symbol in symbols:
        state = len(following)
        following.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and symbol not in following[p]:
            following[p][symbol] = state
            p = link[p]
        if p >= 0:
            q = following[p][symbol]
            if length[q] == length[p] + 1:
                link[state] = q
            else:
                copy = len(following)
                following.append(dict(following[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and following[p].get(symbol) == q:
                    following[p][symbol] = copy
                    p = link[p]
                link[q] = link[state] = copy
        last = state
    return following


class Automata:
    """The automata of all languages as one table of edges: memory grows with the letters, not with the alphabet.

    A state is a place in the table, and its edge for a symbol lies so many entries further. Rows of different states
    are pushed into each other's gaps; an entry names the state it belongs to, beside the next one.
    """

    def __init__(self, texts: dict[str, str]):
        #: In the order of `texts`: with equal rates the earlier language wins.
        self.languages = list(texts)
        cleaned = [letters(texts[k]) for k in self.languages]
        known = sorted(set("".join(cleaned)) - {" "})
        #: 0: space and all that is no letter; 1: a letter that no language has.
        self.symbols = 2 + len(known)
        top = max(map(ord, known), default=0) + 1
        self.codes = np.ones(top + 1, np.int64)
        for c in range(top):
            if not chr(c).isalpha():
                self.codes[c] = 0
        for k, c in enumerate(known):
            self.codes[ord(c)] = 2 + k
        rows: list[dict[int, int]] = []
        starts = []
        for text in cleaned:
            starts.append(len(rows))
            rows += [{symbol: starts[-1] + to for symbol, to in edges.items()} for edges in suffix_automaton(self.encode(text).tolist())]
        place = self._places(rows)
        self.table = np.full(int(place.max(initial=0)) + self.symbols + 1, -1, np.int64)
        for state, edges in enumerate(rows):
            for symbol, to in edges.items():
                self.table[place[state] + symbol] = (int(place[state]) << 32) | int(place[to])
        #: The state in which a language's texts begin, and that behind each symbol where a phrase begins with it.
        self.begin = place[starts] if starts else np.zeros(0, np.int64)
        self.roots = np.repeat(self.begin, self.symbols)
        for k, state in enumerate(starts):
            for symbol, to in rows[state].items():
                self.roots[k * self.symbols + symbol] = place[to]

    def _places(self, rows: list[dict[int, int]]) -> np.ndarray:
        """A place of its own for each state, such that no two edges share an entry."""
        edges = sum(map(len, rows))
        size = edges + edges // 2 + 4 * self.symbols + 1024
        free, own = np.ones(2 * size, bool), np.ones(2 * size, bool)
        place = np.full(len(rows), -1, np.int64)
        order = sorted((k for k, x in enumerate(rows) if len(x) > 1), key=lambda k: -len(rows[k]))
        low, span = 0, 256
        for k in order:
            symbols, at = np.array(list(rows[k])), low
            while True:
                at_once = np.arange(at, at + span)
                if at + span + self.symbols > len(free):
                    free, own = np.r_[free, np.ones(size, bool)], np.r_[own, np.ones(size, bool)]
                fits = np.flatnonzero(own[at_once] & free[at_once[:, None] + symbols].all(1))
                if len(fits):
                    break
                at += span
            if at > low:
                low += span // 4
            place[k] = at + fits[0]
            own[place[k]] = False
            free[place[k] + symbols] = False
        single: dict[int, list[int]] = {}
        for k, x in enumerate(rows):
            if len(x) == 1:
                single.setdefault(next(iter(x)), []).append(k)
        for symbol, states in single.items():
            while True:
                at = np.flatnonzero(free[symbol:] & own[: len(own) - symbol])
                if len(at) >= len(states):
                    break
                free, own = np.r_[free, np.ones(size, bool)], np.r_[own, np.ones(size, bool)]
            at = at[: len(states)]
            place[states] = at
            own[at] = False
            free[at + symbol] = False
        rest = np.flatnonzero(place < 0)
        place[rest] = np.flatnonzero(np.r_[own, np.ones(len(rest), bool)])[: len(rest)]
        return place

    def step(self, states: np.ndarray, symbols: np.ndarray, roots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states after a symbol each, and where the phrase ended before it; roots: where each language's begin."""
        entry = self.table[states + symbols]
        fail = (entry >> 32) != states
        return np.where(fail, self.roots[roots + symbols], entry & 0xFFFFFFFF), fail

    def encode(self, text: str) -> np.ndarray:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        out = self.codes[np.minimum(points, len(self.codes) - 1)]
        for c in np.unique(points[points >= len(self.codes) - 1]).tolist():
            out[points == c] = int(chr(c).isalpha())
        return out

    def phrases(self, texts: list[str], lane: int = LANE) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that each language needs for each text, and the letters and gaps parsed of each."""
        codes = []
        for text in texts:
            own = self.encode(text.lower())
            # One gap between two words, whatever stood there.
            gap = own == 0
            own = own[~(gap & np.r_[True, gap[:-1]])] if len(own) else own
            codes.append(own[:-1] if len(own) and own[-1] == 0 else own)
        sizes = np.array([len(x) for x in codes], np.int64)
        counts = np.repeat((sizes > 0).astype(np.float64)[:, None], len(self.languages), axis=1)
        if not sizes.sum() or not self.languages:
            return counts, sizes
        ends, text = self._ends(np.concatenate(codes), sizes, lane)
        for k in range(len(self.languages)):
            counts[:, k] += np.bincount(text, weights=ends[:, k], minlength=len(texts))
        return counts, sizes

    def _ends(self, flat: np.ndarray, sizes: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
        """Ends of phrases in each lane by language, and the lanes' texts.

        Texts are cut into lanes that are read side by side, each as if a text began with it. Then each lane is read
        again from the state in which the one before ended, until the states are those of the first reading, and so on
        until no lane's last state changes.
        """
        n_languages = len(self.languages)
        many = -(-sizes // lane)
        text = np.repeat(np.arange(len(sizes)), many)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
        starts, lengths = (np.cumsum(sizes) - sizes)[text] + nth * lane, np.minimum(lane, sizes[text] - nth * lane)
        order = np.argsort(-lengths, kind="stable")
        text, nth, starts, lengths = text[order], nth[order], starts[order], lengths[order]
        longest = int(lengths[0])
        active = np.searchsorted(-lengths, -np.arange(longest), "left")
        # A column for each lane and language, a row for each step.
        states = np.zeros((longest, len(text) * n_languages), np.int32)
        fails = np.zeros(states.shape, bool)
        roots = np.tile(np.arange(n_languages) * self.symbols, len(text))
        state = np.tile(self.begin, len(text))
        for t in range(longest):
            n = active[t] * n_languages
            state, fail = self.step(state[:n], np.repeat(flat[starts[: active[t]] + t], n_languages), roots[:n])
            states[t, :n], fails[t, :n] = state, fail
        # Where in this order the lane behind each one is.
        where = np.empty(len(order), np.int64)
        where[order] = np.arange(len(order))
        behind = np.full(len(order), -1, np.int64)
        follows = np.flatnonzero(nth > 0)
        behind[where[order[follows] - 1]] = follows
        changed = np.arange(len(text) * n_languages)
        while len(changed):
            before = changed[behind[changed // n_languages] >= 0]
            column = behind[before // n_languages] * n_languages + before % n_languages
            state = states[lengths[before // n_languages] - 1, before].astype(np.int64)
            ended, t = [], 0
            while len(column):
                state, fail = self.step(state, flat[starts[column // n_languages] + t], roots[column])
                differ = state != states[t, column]
                states[t, column], fails[t, column] = state, fail
                t += 1
                last = lengths[column // n_languages] == t
                ended.append(column[last & differ])
                going = differ & ~last
                column, state = column[going], state[going]
            changed = np.concatenate(ended) if ended else changed[:0]
        return fails.sum(0).reshape(len(text), n_languages), text


def letters(text: str) -> str:
    """Lower case, with each run of other characters than letters as one space."""
    return " ".join("".join(c if c.isalpha() else " " for c in text.lower()).split())


def training_rows(docs: DataFrame, learn: Column, rows: int = ROWS_PER_LANGUAGE, row_bytes: int = ROW_BYTES) -> dict[str, str]:
    """Labelled text of each language, the language with most labelled rows first.

    Whole rows, up to `rows` different ones of at most `row_bytes` bytes, in the order of a hash of their ids; a
    language that has only longer ones gives its shortest.
    """
    labelled = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    labelled = labelled.select("lang", "doc_id", "text", F.xxhash64("text").alias("row"))
    counts = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    long = F.octet_length("text") > row_bytes
    place = F.struct(long.alias("long"), F.when(long, F.octet_length("text")).alias("size"), F.xxhash64("doc_id").alias("hash"), "doc_id", "row")
    ids = labelled.select("lang", place.alias("place")).distinct()
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("place"))
    chosen = ids.withColumn("nth", nth).where((F.col("nth") <= rows) & (~F.col("place.long") | (F.col("nth") == 1)))
    chosen = chosen.select(F.col("lang").alias("_lang"), F.col("place.doc_id").alias("_id"), F.col("place.row").alias("_row"), "nth")
    # A bounded number of rows for each language, of bounded bytes.
    met = (F.col("lang") == F.col("_lang")) & (F.col("doc_id") == F.col("_id")) & (F.col("row") == F.col("_row"))
    table = labelled.join(F.broadcast(chosen), met).select("lang", "nth", "text").toPandas().sort_values(["lang", "nth"]).drop_duplicates(["lang", "nth"])
    made = {language: " ".join(letters(x) for x in own.text) for language, own in table.groupby("lang")}
    return {k: made[k] for k in sorted(made, key=lambda x: (-counts[x], x)) if made[k].strip()}


def identify(docs: DataFrame, texts: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """Adds lang_pred, score and phrase_rate to the kept columns of docs; columns with these names are replaced.

    A null text or one without a letter is `und` with score 0. With equal rates the language with more labelled rows wins.
    Score is the runner-up's rate against the sum of both: 0.5 for a tie, towards 1 the clearer. An empty table
    gives an empty table; repeated rows are each answered. phrase_rate is of the phrases after the first.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in COLUMNS]
    names = list(texts)
    if len(names) > LANGUAGES_AT_ONCE:
        return _in_blocks(docs, texts, keep)
    rows = docs.select(*dict.fromkeys([*keep, "text"]))
    model = docs.sparkSession.sparkContext.broadcast(Automata(texts))

    def run(part, data, offsets):
        best, second, counts, sizes, known = _two_best(model.value, batches.strings(data, offsets))
        languages = [names[k] if there else "und" for k, there in zip(best.tolist(), known.tolist())]
        rates = np.where(known, (counts - 1) / np.maximum(1, sizes), 1.0)
        scores = np.where(known, np.where(np.isinf(second), 1.0, second / np.where(np.isinf(second), 1, counts + second)), 0.0)
        out = [part.column(part.schema.get_field_index(c)) for c in keep]
        return pa.RecordBatch.from_arrays([*out, pa.array(languages, pa.string()), pa.array(scores), pa.array(rates)], names=[*keep, *COLUMNS])

    schema = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema]
    return batches.map_slices(rows, run, ", ".join([*schema, SCHEMA]), limit=SLICE_BYTES)


def _two_best(automata: Automata, found: list[str]) -> tuple[np.ndarray, ...]:
    """Of each text the language with the fewest phrases, the runner-up's phrases (infinite if there is none), the winner's, the letters parsed, and whether there is a letter and a language."""
    counts, sizes = automata.phrases(found)
    known = np.array([any(c.isalpha() for c in x) for x in found], bool) & (len(automata.languages) > 0)
    if not len(automata.languages):
        return np.zeros(len(found), np.int64), np.full(len(found), np.inf), np.ones(len(found)), sizes, known
    order = np.argsort(counts, axis=1, kind="stable")
    pick = lambda k: np.take_along_axis(counts, order[:, k : k + 1], 1)[:, 0]
    return order[:, 0], pick(1) if counts.shape[1] > 1 else np.full(len(found), np.inf), pick(0), sizes, known


def _in_blocks(docs: DataFrame, texts: dict[str, str], keep: list[str]) -> DataFrame:
    """identify() for any number of languages: each block's automata are held alone, and its two best counts are written.

    Passes grow with the languages, memory does not. docs is read once for each block and must give its rows in one order.
    """
    names, row, spark = list(texts), batches.free_name(docs, "row"), docs.sparkSession
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    with scratch(spark) as kept:
        found = None
        for first in range(0, len(names), LANGUAGES_AT_ONCE):
            model = spark.sparkContext.broadcast(Automata({k: texts[k] for k in names[first : first + LANGUAGES_AT_ONCE]}))

            def run(part, data, offsets, model=model, first=first):
                best, second, counts, sizes, known = _two_best(model.value, batches.strings(data, offsets))
                return batches.record(nth=part.column(part.schema.get_field_index(row)), best=pa.array(best + first), phrases=pa.array(counts), second=pa.array(second), size=pa.array(sizes), known=pa.array(known))

            own = kept(batches.map_slices(rows.select(row, "text"), run, "nth bigint, best bigint, phrases double, second double, size bigint, known boolean", limit=SLICE_BYTES))
            model.destroy()
            found = own if found is None else found.unionByName(own)
        # Two counts a block: of equal ones the earlier language wins.
        counts = F.array_sort(F.flatten(F.collect_list(F.array("phrases", "second"))))
        merged = found.groupBy("nth").agg(F.min(F.struct("phrases", "best")).alias("first"), counts[1].alias("second"), F.max("size").alias("size"), F.max("known").alias("known"))
        score = F.col("second") / (F.col("first.phrases") + F.col("second"))
        language = F.element_at(F.array(*map(F.lit, names)), F.col("first.best").cast("int") + 1)
        rate = (F.col("first.phrases") - 1) / F.greatest("size", F.lit(1))
        out = merged.select("nth", F.when(F.col("known"), language).otherwise("und").alias("lang_pred"), F.when(F.col("known"), score).otherwise(0.0).alias("score"), F.when(F.col("known"), rate).otherwise(1.0).alias("phrase_rate"))
        out = checkpointed(out)
    own = rows.drop(*COLUMNS)
    return own.join(out, own[row] == out["nth"]).select(*keep, *COLUMNS)


def known_languages(docs: DataFrame, worst: float = WORST_RATE) -> DataFrame:
    """The documents with a letter that a learned language parses, all columns as they were but for a missing lang, which is filled in.

    Labels are learned as in train(). Repeated rows each stay or go; an empty table stays empty.
    """
    clashing = {c: batches.free_name(docs, f"own_{c}") for c in COLUMNS if c in docs.columns}
    own = docs.withColumnsRenamed(clashing)
    found = identify(own, train(docs))
    known = found.where((F.col("lang_pred") != "und") & (F.col("phrase_rate") <= worst))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*own.columns).toDF(*docs.columns)


def train(docs: DataFrame) -> dict[str, str]:
    """From documents whose crc32(doc_id) mod 4 is not 2; the rest stays for measuring."""
    return training_rows(docs, bucket(F.col("doc_id"), 4) != 2)
