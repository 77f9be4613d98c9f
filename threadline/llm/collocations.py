"""Phrase collocations from sorted count streams.

Tasks count one-, two- and three-word phrases of chunks of text and hand them on as sorted, compressed
runs, one for each bucket of phrases. A task then adds up the runs of a bucket; the number of buckets
follows from the size of the corpus, so a bucket always fits a task, and a phrase has one line for each
chunk at most. Phrases that are frequent enough are the count streams. The streams are then walked twice, each walk a lockstep merge of the sorted one-, two- and three-word
streams without look-up tables: in prefix order a phrase follows its own first words, which gives the
counts of its left parts and the largest count of its extensions to the right; in suffix order it
follows its own last words, which gives the right parts and the extensions to the left. Both walks
hold one phrase of each length in memory, whatever the size of a group.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pa_csv
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from threadline.llm.common import mix64, prepare, release, stage, texts

# A byte that UTF-8 never uses marks the ends of pieces.
PIECE_END = b"\xff"
# A-Z in lower case, the ends of pieces, and the tab as a blank.
PHRASE_BYTES = bytes.maketrans(
    bytes(range(65, 91)) + b".,;:!?\n\x0b\x0c\r\t", bytes(range(97, 123)) + PIECE_END * 10 + b" "
)
LONGEST = 3
#: Words counted at once in a task.
CHUNK_WORDS = 1_500_000
#: Bytes of text for each bucket of phrases: some three million phrases meet in one.
BUCKET_BYTES = 16_000_000
#: Distinct words of one chunk.
CHUNK_VOCABULARY = 1_000_000
#: Places over which the phrases that share a hot first (or last) word are spread. A word is hot when it
#: has more rows than both HOT_ROWS and one in HOT_WORDS of all, so there are never more than HOT_WORDS.
SPREAD = 64
HOT_ROWS = 65_536
HOT_WORDS = 4096
WALK_ROWS = 20_000


def words_of(text: str) -> list[bytes]:
    """The words of a whole text, with ``PIECE_END`` between pieces and at the end."""
    return [*text.encode().translate(PHRASE_BYTES).replace(PIECE_END, b" " + PIECE_END + b" ").split(), PIECE_END]


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _distinct(ids: np.ndarray, real: np.ndarray, words: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """The distinct runs of one to ``LONGEST`` words, as one array of numbers for each place, and their counts."""
    key, inside, decode = ids, real, None
    for size in range(1, LONGEST + 1):
        if size > 1:
            end = len(ids) - size + 1
            if end <= 0:
                return
            key, inside = key[:end], inside[:end] & real[size - 1 :]
            if words**size >= 1 << 63:  # one enormous text: pairs by their number (two words always fit)
                shorter, key = np.unique(key, return_inverse=True)
                decode = shorter
            key = key * words + ids[size - 1 :]
        distinct, counts = np.unique(key[inside], return_counts=True)
        parts, rest = [], distinct
        for _ in range(size - 1):
            parts.append(rest % words)
            rest = rest // words
            if decode is not None and len(parts) == 1:
                rest = decode[rest]
        yield [rest, *parts[::-1]], counts


def _escaped(lang: str) -> str:
    for sign, letter in _ESCAPES:
        lang = lang.replace(sign, "\\" + letter)
    return lang


def _unescaped(lang: str) -> str:
    return _ESCAPED.sub(lambda m: {letter: sign for sign, letter in _ESCAPES}[m.group(1)], lang)


# Signs that would end a field or a line of a run; words never hold the last three.
_ESCAPES = (("\\", "b"), ("\t", "t"), ("\n", "n"), ("\r", "r"))
_ESCAPED = re.compile(r"\\([btnr])")


def _count_chunk(by_lang: dict[str, list[np.ndarray]], numbers: dict[bytes, int], buckets: int) -> Iterator[pa.RecordBatch]:
    """Runs of a chunk: for each bucket the compressed lines (language, phrase, count), sorted by language and words.

    The empty phrase carries the number of words.
    """
    ordered = sorted(numbers)  # the mark of piece ends sorts behind every word
    rank = np.empty(len(ordered), np.int64)
    rank[[numbers[w] for w in ordered]] = np.arange(len(ordered))
    words = pa.array(ordered[:-1], pa.binary()).cast(pa.string())
    hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in ordered], np.uint64)
    lines: dict[int, list[bytes]] = {}

    def add(lang: str, phrase: pa.Array, counts: np.ndarray, bucket: np.ndarray) -> None:
        if not len(counts):
            return
        order = np.argsort(bucket, kind="stable")
        own = pc.binary_join_element_wise(
            _escaped(lang), phrase.take(pa.array(order)), pc.binary_join_element_wise(pa.array(counts[order]).cast(pa.string()), "", "\n"), "\t"
        )
        text, offsets = own.buffers()[2].to_pybytes(), np.frombuffer(own.buffers()[1], np.int32)[: len(own) + 1]
        kinds, starts = np.unique(bucket[order], return_index=True)
        for k, lo, hi in zip(kinds.tolist(), starts.tolist(), [*starts[1:].tolist(), len(order)], strict=True):
            lines.setdefault(k, []).append(text[offsets[lo] : offsets[hi]])

    for lang in sorted(by_lang):
        ids = rank[np.concatenate(by_lang[lang])]
        real = ids != len(ordered) - 1
        own = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
        add(lang, pa.array([""]), np.array([real.sum()]), (mix64(np.array([own])) % np.uint64(buckets)).astype(np.int64))
        for parts, counts in _distinct(ids, real, len(ordered)):
            value = np.full(len(counts), own)
            for part in parts:
                value = mix64(value ^ hashes[part])
            taken = [words.take(pa.array(p)) for p in parts]
            phrase = taken[0] if len(taken) == 1 else pc.binary_join_element_wise(*taken, " ")
            add(lang, phrase, counts, (value % np.uint64(buckets)).astype(np.int64))
    press = zstandard.ZstdCompressor(level=3)
    for k in sorted(lines):
        yield pa.RecordBatch.from_pydict(
            {"bucket": pa.array([k], pa.int64()), "run": pa.array([press.compress(b"".join(lines.pop(k)))], pa.binary())}
        )


def _add_runs(runs: pa.Table, least: int) -> pa.RecordBatch:
    """The sums of the runs of a bucket, without phrases that are too rare."""
    press = zstandard.ZstdDecompressor()
    names = ["lang", "phrase", "f"]
    tables = [
        pa_csv.read_csv(
            pa.BufferReader(press.decompress(run)),
            read_options=pa_csv.ReadOptions(column_names=names, block_size=1 << 22),
            parse_options=pa_csv.ParseOptions(delimiter="\t", quote_char=False, ignore_empty_lines=False),
            convert_options=pa_csv.ConvertOptions(
                column_types={"lang": pa.dictionary(pa.int32(), pa.string()), "phrase": pa.string(), "f": pa.int64()}, strings_can_be_null=False
            ),
        )
        for run in runs.column("run").to_pylist()
    ]
    every = pa.concat_tables(tables).unify_dictionaries()
    del tables
    found = every.group_by(["lang", "phrase"]).aggregate([("f", "sum")])
    found = found.filter(pc.or_(pc.greater_equal(found["f_sum"], least), pc.equal(found["phrase"], "")))
    langs = [_unescaped(x) for x in found["lang"].cast(pa.string()).to_pylist()]
    return pa.RecordBatch.from_pydict(
        {"lang": pa.array(langs, pa.string()), "phrase": found["phrase"].combine_chunks(), "f": found["f_sum"].combine_chunks()}
    )


def count_streams(docs: DataFrame, least: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, phrase, f) of the phrases of one to three words with f >= least; the empty phrase counts all words."""
    size = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    buckets = max(1, -(-size // BUCKET_BYTES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, by_lang, held = _Numbers(), {}, 0
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), texts(batch, "text"), strict=True):
                words = words_of(text)
                by_lang.setdefault(lang, []).append(np.fromiter(map(numbers.__getitem__, words), np.int64, len(words)))
                held += len(words)
                if held >= CHUNK_WORDS or len(numbers) >= CHUNK_VOCABULARY:
                    yield from _count_chunk(by_lang, numbers, buckets)
                    numbers, by_lang, held = _Numbers(), {}, 0
        if held:
            yield from _count_chunk(by_lang, numbers, buckets)
        release()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _add_runs(pa.Table.from_batches(list(batches)), least)
        release()

    prepare(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    runs = rows.mapInArrow(run, "bucket long, run binary")
    return runs.groupBy("bucket").applyInArrow(add, "lang string, phrase string, f long")


def _walk(rows: DataFrame, finish: Callable[[dict], tuple | None], schema: str) -> DataFrame:
    """One lockstep walk over the streams.

    ``rows`` has (lang, a, b, c, f) and what an earlier walk found (left_one, left_two, inside), with
    a, b, c the words in the order of the walk. A one-word row sets the count of its word, a two-word
    row that of its pair; a row comes out with both counts and, a pair, with the largest count of its
    extensions. All rows of a pair lie in one partition; those of a hot word are spread by their second
    word, and the row of the word itself goes to every place.
    """
    sizes = rows.groupBy("lang", "a").count()
    limit = max(HOT_ROWS, rows.count() // HOT_WORDS)
    hot = sizes.where(F.col("count") > limit).select("lang", "a", F.lit(True).alias("hot"))  # at most HOT_WORDS rows
    spread = F.pmod(F.xxhash64("b"), F.lit(SPREAD)).cast("int")
    salts = (
        F.when(F.col("hot").isNull(), F.array(F.lit(0)))
        .when(F.col("b").isNull(), F.sequence(F.lit(0), F.lit(SPREAD - 1)))
        .otherwise(F.array(spread))
    )
    placed = rows.join(F.broadcast(hot), ["lang", "a"], "left").withColumn("salt", F.explode(salts))
    dealt = placed.repartition("lang", "a", "salt").sortWithinPartitions("lang", "a", "b", "c")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        names = [f.split()[0] for f in schema.split(", ")]

        def flush() -> pa.RecordBatch:
            kinds = {"long": pa.int64(), "string": pa.string()}
            columns = zip(*out, strict=True) if out else [()] * len(names)
            batch = pa.RecordBatch.from_pydict(
                {n: pa.array(list(c), kinds[s.split()[1]]) for n, c, s in zip(names, columns, schema.split(", "), strict=True)}
            )
            out.clear()
            return batch

        word = pair = None  # the one- and two-word row that the walk is behind

        def done(row: dict | None) -> None:
            found = None if row is None else finish(row)
            if found is not None:
                out.append(found)

        for batch in batches:
            for row in batch.to_pylist():
                if row["b"] is None:
                    done(pair)
                    word, pair = row, None
                    continue
                row["first"] = word["f"]
                if row["c"] is None:
                    done(pair)
                    row["second"] = None
                    pair = row
                else:
                    row["second"] = pair["f"]
                    pair["inside"] = max(pair["inside"] or 0, row["f"])
                    done(row)
                if len(out) >= WALK_ROWS:
                    yield flush()
        done(pair)
        if out:
            yield flush()

    prepare(rows.sparkSession)
    columns = ("lang", "a", "b", "c", "f", "left_one", "left_two", "inside")
    return dealt.select(*columns).mapInArrow(run, schema)


PREFIX_SCHEMA = "lang string, a string, b string, c string, f long, left_one long, left_two long, inside long"
SCORED_SCHEMA = "lang string, phrase string, a long, l long, r long, score long, inside long"


def _after_prefix(row: dict) -> tuple:
    return row["lang"], row["a"], row["b"], row["c"], row["f"], row["first"], row["second"], row["inside"]


def _after_suffix(row: dict) -> tuple:
    """The lowest-scoring cut, in exact integers; ``first`` and ``second`` count the last word and the last two."""
    f = row["f"]
    if row["c"] is None:
        words, cuts = (row["b"], row["a"]), [(row["left_one"], row["first"])]
    else:
        words = (row["c"], row["b"], row["a"])
        cuts = [(row["left_one"], row["second"]), (row["left_two"], row["first"])]
    scored = [(1_000_000 * f * f // (left * right), left, right) for left, right in cuts]
    score, left, right = min(scored, key=lambda s: s[0])  # the first of equals: the smallest cut
    return row["lang"], " ".join(words), f, left, right, score, row["inside"]


def scored_phrases(streams: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score, inside) of all phrases of two and three words of the streams.

    ``inside`` is the largest count of a three-word phrase that holds a two-word one.
    """
    words = F.split("phrase", " ")
    rows = streams.where("phrase <> ''").select(
        "lang", F.get(words, F.lit(0)).alias("a"), F.get(words, F.lit(1)).alias("b"), F.get(words, F.lit(2)).alias("c"), "f"
    )
    rows = rows.select("*", *[F.lit(None).cast("long").alias(n) for n in ("left_one", "left_two", "inside")])
    singles = rows.where("b IS NULL")
    prefix = stage(_walk(rows, _after_prefix, PREFIX_SCHEMA), "prefix-order")
    turned = prefix.select(
        "lang",
        F.coalesce("c", "b").alias("a"),
        F.when(F.col("c").isNull(), F.col("a")).otherwise(F.col("b")).alias("b"),
        F.when(F.col("c").isNotNull(), F.col("a")).alias("c"),
        "f",
        "left_one",
        "left_two",
        "inside",
    )
    return _walk(singles.unionByName(turned), _after_suffix, SCORED_SCHEMA)


def collocations(
    docs: DataFrame, least: int = 10, covered_percent: int = 50, top: int = 2000, lang_col: str = "lang", text_col: str = "text"
) -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Null languages are ``und``, null texts empty; a language without phrases that are frequent enough
    has no rows, an empty table none at all. Repeated rows count each time. Equal scores are ranked by
    frequency, then by the bytes of the phrase. Other columns are not read.
    """
    streams = stage(count_streams(docs, least, lang_col, text_col), "streams")
    found = scored_phrases(streams)
    kept = found.where(F.lit(100) * F.coalesce("inside", F.lit(0)) < F.lit(covered_percent) * F.col("a")).drop("inside")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of every share of a language first, so that a large language is not one task's sort.
    share = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SPREAD))).orderBy(*order)
    some = kept.withColumn("place", F.row_number().over(share)).where(F.col("place") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top)
    totals = streams.where("phrase = ''").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
