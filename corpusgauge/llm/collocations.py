"""Phrases whose words stand together more often than apart, counted in burst tries and sorted runs.

Every place of a text is one window: its word and up to four that follow in the same piece.  A phrase's
count is the number of windows that begin with it, so one trie of windows counts all lengths.

1. A task keeps windows in a shallow trie over its own word ids.  A leaf is a hash container of a range of prefixes;
   one that grows too large bursts into two, between first words, then second, then third ones.  At a limit of
   memory the largest subtrees are spilled as sorted runs.
2. Runs go to partitions by their prefix: windows by their first three words, counts of words and of pairs by
   these.  So a pair that a third of all windows begin with is still one count a run, and its windows spread.
3. A prefix partition gives its runs one set of word ids, sorts them together and adds up every prefix length.

A run spells its words once, so runs are kept long: with more than ``WIDTH`` partitions, runs of many tasks
are first added up in coarse partitions and cut into finer ones from there.  Scores and the dropping of parts are joins on the phrases that are frequent enough.  Everything is per language; a null
language is ``und``, null texts are empty, rows with one id count one each, other columns are not read.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusgauge.functions.joins import spread_join
from corpusgauge.functions.ranking import top_per_group
from corpusgauge.llm.bpe import cut_batches, pack, unpack
from corpusgauge.llm.common import gives_back, table
from corpusgauge.llm.shingles import STEPS, mixed
from corpusgauge.session import written_once

MOST_WORDS = 5
#: Text cut into words at a time, and windows sorted at a time.
BATCH_BYTES = 4_000_000
CHUNK = 400_000
#: Windows in a container before it bursts, and in all containers of a task before some are spilled.
BURST = 100_000
BUDGET = 1_500_000
#: Word ids of a task have 21 bits.
WORD_BITS = 21
MOST_IDS = 500_000
#: Text for each prefix partition.
PART_BYTES = 12_000_000
LEAST_PARTS = 64
#: Partitions that a run is cut into at a time, and runs that are added up in between.
WIDTH = 256
TOGETHER = 64

LETTER, BLANK, END = 0, 1, 2
_KIND = np.zeros(256, np.uint8)
_KIND[[0x20, 0x09]] = BLANK
_KIND[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = END
_LOW = np.uint64((1 << WORD_BITS) - 1)


def words_and_pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, A-Z as a-z, and the number of the piece that each is in."""
    texts = pa.concat_arrays([pc.ascii_lower(texts)])  # offsets from 0
    ends = np.frombuffer(texts.buffers()[1], np.int32)[: len(texts) + 1]
    if not ends[-1]:
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8)[: ends[-1]]
    kind = _KIND[data]
    solid = kind == LETTER
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first = np.flatnonzero(solid & (edge[:-1] | np.append(True, ~solid[:-1])))
    letters = data[solid]
    offsets = np.append(np.cumsum(solid)[first] - 1, len(letters)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(letters))
    return words, np.cumsum(kind == END)[first] + np.searchsorted(ends, first, "right")


def run_sums(columns: list[np.ndarray], n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the runs of equal rows in sorted columns, and the sum of ``n`` over each."""
    if not len(n):
        return np.zeros(0, np.int64), n
    new = np.ones(len(n), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(new)
    return at, np.add.reduceat(n, at)


class Container:
    """Windows of a range of prefixes with their counts; what is added waits and is hashed together in bulk."""

    def __init__(self, rows=()):
        self.rows, self.waiting = list(rows), 0

    def __len__(self) -> int:
        return sum(len(r[0]) for r in self.rows)

    def add(self, high, low, n) -> None:
        self.rows.append((high, low, n))
        self.waiting += len(high)

    def folded(self):
        """Its distinct windows."""
        if len(self.rows) > 1:
            both = pa.table([np.concatenate(c) for c in zip(*self.rows, strict=True)], names=["high", "low", "n"])
            sums = both.group_by(["high", "low"], use_threads=False).aggregate([("n", "sum")])
            self.rows = [tuple(sums[c].to_numpy() for c in ("high", "low", "n_sum"))]
        self.waiting = 0
        return self.rows[0]

    def burst(self):
        """(bound, container): its upper half, from a prefix as short as tells its windows apart; None if three words do not."""
        high, low, n = self.folded()
        order = np.argsort(high, kind="stable")
        high, low, n = high[order], low[order], n[order]
        for words in (1, 2, 3):
            prefix = high >> np.uint64(WORD_BITS * (3 - words))
            if prefix[0] != prefix[-1]:
                middle = prefix[len(prefix) // 2]
                left, right = np.searchsorted(prefix, [middle, middle + np.uint64(1)])
                at = left if left and (right == len(prefix) or len(prefix) - right < left) else right
                self.rows = [(high[:at], low[:at], n[:at])]
                return int(prefix[at]) << WORD_BITS * (3 - words), Container([(high[at:], low[at:], n[at:])])
        return None


class Trie:
    """Containers of one language, by the least prefix that each holds."""

    def __init__(self):
        self.bounds, self.leaves = [0], [Container()]

    def __len__(self) -> int:
        return sum(map(len, self.leaves))

    def add(self, high: np.ndarray, low: np.ndarray) -> None:
        order = np.lexsort((low, high))
        high, low = high[order], low[order]
        at, n = run_sums([high, low], np.ones(len(high), np.int64))
        high, low = high[at], low[at]
        cuts = [*np.searchsorted(high, np.array(self.bounds, np.uint64)).tolist(), len(high)]
        for i in range(len(self.leaves) - 1, -1, -1):  # backwards, as bursting puts leaves in
            if cuts[i] < cuts[i + 1]:
                leaf, own = self.leaves[i], slice(cuts[i], cuts[i + 1])
                leaf.add(high[own], low[own], n[own])
                if leaf.waiting > max(BURST // 4, len(leaf) // 2):
                    leaf.folded()
                    self._burst(i)

    def _burst(self, i: int) -> None:
        if len(self.leaves[i]) > BURST and (upper := self.leaves[i].burst()):
            at = bisect.bisect(self.bounds, upper[0])
            self.bounds.insert(at, upper[0])
            self.leaves.insert(at, upper[1])
            self._burst(at)
            self._burst(i)


RUNS = "part long, origin long, lang string, words binary, counts binary"
_RUNS = pa.schema([("part", pa.int64()), ("origin", pa.int64()), ("lang", pa.string()), ("words", pa.binary()), ("counts", pa.binary())])


def written_runs(lang: str, columns: list[np.ndarray], n: np.ndarray, spelt: list[bytes], crc: np.ndarray, parts: int, origin: int):
    """Sorted windows as a run for each prefix partition; a run spells its words once."""
    place = np.full(len(n), zlib.crc32(lang.encode()), np.uint64)
    for j, column in enumerate(columns[:3]):
        place = mixed(place * np.uint64(STEPS[j]) + crc[column])
    part = (place % np.uint64(parts)).astype(np.int64)
    order = np.argsort(part, kind="stable")
    edges = np.flatnonzero(np.diff(part[order], prepend=-1, append=-1))
    press = zstandard.ZstdCompressor(level=1)
    for s, e in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        own = order[s:e]
        used, numbers = np.unique(np.stack([c[own] for c in columns]), return_inverse=True)
        if used[0]:
            used, numbers = np.append(used[:1] * 0, used), numbers + 1  # 0 stands for no word
        words = press.compress(b" ".join(spelt[i] for i in used[1:].tolist()))
        counts = pack(*numbers.reshape(MOST_WORDS, -1), n[own] & 0xFFFFFFFF, n[own] >> 32)
        row = {"part": int(part[own[0]]), "origin": origin, "lang": lang, "words": words, "counts": counts}
        yield pa.RecordBatch.from_pylist([row], _RUNS)


def merged(part: pa.Table):
    """(lang, words, columns, n) of the runs of a partition: sorted windows, equal ones side by side, in one numbering from 1."""
    opened = zstandard.ZstdDecompressor()
    for lang in pc.unique(part["lang"]).to_pylist():
        own = part.filter(pc.equal(part["lang"], lang))
        lists = [opened.decompress(w.as_py()).decode().split(" ") for w in own["words"]]
        coded = pa.chunked_array([pa.array(x, pa.string()) for x in lists]).combine_chunks().dictionary_encode()
        sizes = [len(x) for x in lists]
        del lists
        codes, runs, at = coded.indices.to_numpy(zero_copy_only=False) + 1, [], 0
        for words, counts in zip(sizes, own["counts"], strict=True):
            ids = np.append(0, codes[at : at + words]).astype(np.uint32)
            at += words
            *columns, low, high = unpack(counts.as_py())
            runs.append([*[ids[c] for c in columns], low + (high << 32)])
        *w, n = (np.concatenate(c) for c in zip(*runs, strict=True))
        del runs
        keys = [w[0].astype(np.uint64) << np.uint64(32) | w[1], w[2].astype(np.uint64) << np.uint64(32) | w[3], w[4]]
        order = np.lexsort(keys[::-1])
        del keys
        yield lang, coded.dictionary, [c[order] for c in w], n[order]


class Counter:
    """Tries of a task by language, over one numbering of words from 1."""

    def __init__(self, parts: int, origin: int = 0):
        self.parts, self.origin, self.tries = parts, origin, {}
        self._forget()

    def _forget(self) -> None:
        self.ids, self.spelt, self.crcs = {}, [b""], [0]

    def add(self, lang: str, texts: pa.Array):
        """Counts the texts; yields runs that had to be spilled."""
        words, pieces = words_and_pieces(texts)
        for start in range(0, len(words), CHUNK):
            ahead = words[start : start + CHUNK + MOST_WORDS - 1].dictionary_encode()
            if len(self.ids) + len(ahead.dictionary) > MOST_IDS:
                yield from self.spill(0)
                self._forget()
            trie = self.tries.setdefault(lang, Trie())
            ids = self._numbered(ahead.dictionary)[ahead.indices.to_numpy(zero_copy_only=False)]
            own, n = pieces[start : start + len(ids)], min(CHUNK, len(ids))
            columns = []
            for j in range(MOST_WORDS):
                column, m = np.zeros(n, np.uint64), min(n, len(ids) - j)
                column[:m] = np.where(own[j : j + m] == own[:m], ids[j : j + m], 0)
                columns.append(column)
            w1, w2, w3, w4, w5 = columns
            b = np.uint64(WORD_BITS)
            trie.add((w1 << b | w2) << b | w3, w4 << b | w5)
            if sum(map(len, self.tries.values())) > BUDGET:
                yield from self.spill(BUDGET // 3)

    def _numbered(self, words: pa.Array) -> np.ndarray:
        out = np.empty(len(words), np.uint64)
        for i, w in enumerate(words.cast(pa.binary()).to_pylist()):
            no = self.ids.get(w)
            if no is None:
                no = self.ids[w] = len(self.spelt)
                self.spelt.append(w)
                self.crcs.append(zlib.crc32(w))
            out[i] = no
        return out

    def spill(self, left: int):
        """Writes the largest subtrees until at most ``left`` windows are kept."""
        sizes = sorted(((len(leaf), lang, i) for lang, trie in self.tries.items() for i, leaf in enumerate(trie.leaves)), reverse=True)
        total, going = sum(s for s, _, _ in sizes), {}
        for size, lang, i in sizes:
            if total <= left or not size:
                break
            total -= size
            going.setdefault(lang, []).append(i)
        for lang, leaves in going.items():
            trie, held = self.tries[lang], []
            for i in leaves:
                held.append(trie.leaves[i].folded())
                trie.leaves[i] = Container()
            yield from self._runs(lang, held)
        if not left:
            self.tries = {}

    def _runs(self, lang: str, held):
        high, low, n = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        order = np.lexsort((low, high))
        high, low, n = high[order], low[order], n[order]
        b, rows = np.uint64(WORD_BITS), []
        for words, key in ((1, high >> b + b), (2, high >> b)):  # counts of words and of pairs, then the windows
            at, sums = run_sums([key], n)
            rows.append((high[at] >> b * np.uint64(3 - words) << b * np.uint64(3 - words), np.zeros(len(at), np.uint64), sums))
        rows[1] = tuple(c[rows[1][0] >> b & _LOW > 0] for c in rows[1])
        rows.append(tuple(c[high & _LOW > 0] for c in (high, low, n)))
        high, low, n = (np.concatenate(c) for c in zip(*rows, strict=True))
        columns = [c.astype(np.uint32) for c in (high >> b + b, high >> b & _LOW, high & _LOW, low >> b, low & _LOW)]
        yield from written_runs(lang, columns, n, self.spelt, np.array(self.crcs, np.uint64), self.parts, self.origin)


FREQUENT = "lang string, words int, phrase string, f long"
_FREQUENT = pa.schema([("lang", pa.string()), ("words", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])


def finer_runs(parts: int):
    """The runs of a partition and some origins added up, cut into the finer partitions."""

    def merge(part: pa.Table) -> pa.Table:
        origin, out = part["origin"][0].as_py() // TOGETHER, []
        for lang, words, columns, n in merged(part):
            at, sums = run_sums(columns, n)
            spelt = [b"", *words.cast(pa.binary()).to_pylist()]
            crc = np.array([zlib.crc32(w) for w in spelt], np.uint64)
            crc[0] = 0
            out += written_runs(lang, [c[at] for c in columns], sums, spelt, crc, parts, origin)
        return pa.Table.from_batches(out, _RUNS)

    return merge


def phrases_of_runs(min_count: int, most: int):
    """Sums of the runs of a prefix partition: frequent phrases, and a row of no words with the words of each language."""

    def merge(part: pa.Table) -> pa.Table:
        out = []
        for lang, spelt, w, n in merged(part):
            alone = w[1] == 0
            out.append(pa.table([[lang], [0], [""], [int(n[alone].sum())]], schema=_FREQUENT))
            for depth in range(1, most + 1):
                mine = alone if depth == 1 else (w[1] > 0) & (w[2] == 0) if depth == 2 else w[depth - 1] > 0
                columns = [c[mine] for c in w[:depth]]
                first, sums = run_sums(columns, n[mine])
                often = sums >= min_count
                first, sums = first[often], sums[often]
                words = [spelt.take(pa.array(c[first].astype(np.int64) - 1)) for c in columns]
                phrases = pc.binary_join_element_wise(*words, " ")
                out.append(pa.table([[lang] * len(sums), [depth] * len(sums), phrases, sums], schema=_FREQUENT))
        return pa.concat_tables(out).combine_chunks()

    return merge


def frequent_phrases(docs: DataFrame, min_count: int = 100, most: int = MOST_WORDS) -> DataFrame:
    """(lang, words, phrase, f): phrases of up to ``most`` words with at least ``min_count`` occurrences in their language.

    Rows of no words hold, in parts, the number of words of a language.
    """
    if not 1 <= most <= MOST_WORDS:
        raise ValueError(f"phrases have 1 to {MOST_WORDS} words")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").where(F.length("text") > 0)
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    wanted = max(LEAST_PARTS, size // PART_BYTES)
    parts = min(wanted, WIDTH)

    def count(batches):
        from pyspark import TaskContext

        counter = Counter(parts, TaskContext.get().partitionId())
        for langs, texts in cut_batches(batches, BATCH_BYTES):
            for lang in pc.unique(langs).to_pylist():
                yield from counter.add(lang, texts.filter(pc.equal(langs, lang)))
        yield from counter.spill(0)

    runs, now = rows.mapInArrow(gives_back(count), RUNS), parts
    while now < wanted:
        now *= min(WIDTH, -(-wanted // now))  # a multiple, so that what was together in a partition is cut, not dealt anew
        runs = runs.groupBy("part", F.floor(F.col("origin") / TOGETHER)).applyInArrow(gives_back(finer_runs(now)), RUNS)
    return runs.groupBy("part").applyInArrow(gives_back(phrases_of_runs(min_count, most)), FREQUENT)


def collocations(docs: DataFrame, min_count: int = 100, most: int = MOST_WORDS, percent: int = 100, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of two words or more of each language.

    A phrase is cut where ``floor(1000 * a * n / (l * r))`` is least (then where its first part is shortest).  It goes
    if a longer one that holds it has ``percent`` of its occurrences.  Texts without words give no rows.
    """
    known = written_once(frequent_phrases(docs, min_count, most))
    totals = known.where("words = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    found = known.where("words > 0")
    phrases = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    inner = F.expr("""
        flatten(transform(sequence(2, words - 1), k -> transform(sequence(0, words - k), i ->
            substring_index(substring_index(phrase, ' ', i + k), ' ', -k))))
    """)
    held = (
        phrases.where("words > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
        .groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    )
    kept = phrases.join(held, ["lang", "phrase"], "left").where(
        F.col("longer").isNull() | (100 * F.col("longer") < percent * F.col("a"))
    )
    cuts = kept.select("lang", "phrase", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k", F.expr("substring_index(phrase, ' ', k)").alias("head"),
        F.expr("substring_index(phrase, ' ', k - words)").alias("rest"),
    )
    heads = found.select("lang", F.col("phrase").alias("head"), F.col("f").alias("l"))
    rests = found.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = spread_join(spread_join(cuts, heads, ["lang", "head"], "inner"), rests, ["lang", "rest"], "inner")
    counted = spread_join(both, totals, ["lang"], "inner", spread_by=["phrase"])
    wide = {c: F.col(c).cast("decimal(17,0)") for c in "alrn"}  # products of two have 34 digits, with 1000 times 37
    score = F.call_function("div", F.lit(1000).cast("decimal(4,0)") * (wide["a"] * wide["n"]), wide["l"] * wide["r"])
    least = counted.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    rows = least.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    return top_per_group(rows, ["lang"], order, top).select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score"
    )


def op12_collocations(spark, sf_dir: str) -> DataFrame:
    """The leading phrases of each language of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


def collocations_sql(min_count: int = 100, percent: int = 100, top: int = 2000) -> str:
    """DuckDB text of :func:`collocations` for phrases of 2 to 5 words."""
    return f"""
WITH texts AS (
  SELECT coalesce(lang, 'und') AS lang,
    string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]') AS p FROM documents
),
pieces AS (SELECT lang, unnest(p) AS piece FROM texts),
split AS (SELECT lang, [x FOR x IN string_split_regex(piece, '[\\x20\\x09]+') IF x <> ''] AS w FROM pieces),
totals AS (SELECT lang, cast(sum(len(w)) AS bigint) AS n FROM split GROUP BY lang),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM split WHERE len(w) > 0),
grams AS (SELECT lang, w[i : i + k - 1] AS g, k FROM places, (SELECT unnest(range(1, 6)) AS k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS f FROM grams GROUP BY lang, k, phrase HAVING count(*) >= {min_count}),
inner_parts AS (
  SELECT lang, f, array_to_string(g[i : i + m - 1], ' ') AS phrase
  FROM f, (SELECT unnest(range(2, 5)) AS m), (SELECT unnest(range(1, 5)) AS i) WHERE m < k AND i + m - 1 <= k
),
longer AS (SELECT lang, phrase, max(f) AS most FROM inner_parts GROUP BY lang, phrase),
cand AS (
  SELECT f.* FROM f LEFT JOIN longer USING (lang, phrase)
  WHERE k >= 2 AND (most IS NULL OR 100 * most < {percent} * f)
),
cuts AS (
  SELECT c.lang, c.phrase, c.f AS a, j, l.f AS l, r.f AS r, n, cast(1000 AS hugeint) * c.f * n // (cast(l.f AS hugeint) * r.f) AS score
  FROM cand c, (SELECT unnest(range(1, 5)) AS j), f l, f r, totals t
  WHERE j < c.k AND l.lang = c.lang AND l.phrase = array_to_string(c.g[1 : j], ' ') AND r.lang = c.lang
    AND r.phrase = array_to_string(c.g[j + 1 : c.k], ' ') AND t.lang = c.lang
),
best AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
SELECT lang, rank, phrase, a, l, r, n, cast(score AS bigint) AS score FROM ranked WHERE rank <= {top}
"""
