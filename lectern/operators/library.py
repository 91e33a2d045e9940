"""Rules of a library's chapters, editions and pages, as DataFrame functions."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from heapq import heappop, heappush

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .relational import first_rule

BATCH = 32


# ---- index ----


def index_units(files: DataFrame, chapters: DataFrame, variants: DataFrame) -> DataFrame:
    """What is to be indexed, of three tables (id, text): raw files, chapters and finished translations."""
    tagged = [t.where("text IS NOT NULL").select(F.lit(kind).alias("kind"), "id", "text") for kind, t in (("raw", files), ("chapter", chapters), ("translation", variants))]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


def scope_refresh(rows: DataFrame, scopes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """rows with columns as scopes has them, and changed where any differs (null equals null)."""
    new = scopes.select(key, *[F.col(c).alias(f"__{c}") for c in columns])
    out = rows.join(new, key, "left").withColumn("changed", F.lit(False))
    for c in columns:
        out = out.withColumn("changed", F.col("changed") | ~F.col(c).eqNullSafe(F.col(f"__{c}")))
    return out.withColumns({c: F.col(f"__{c}") for c in columns}).drop(*[f"__{c}" for c in columns])


def pending_batches(chunks: DataFrame, unit: str, order: list[Column], vector: str, size: int = BATCH) -> DataFrame:
    """Chunks without a vector, with the batch of `size` of their unit in which they are embedded, oldest first."""
    place = F.row_number().over(Window.partitionBy(unit).orderBy(*order)) - 1
    return chunks.where(F.col(vector).isNull()).withColumn("batch", F.floor(place / size).cast("int"))


def embedded(chunks: DataFrame, key: str, text: str, model: Callable[[list[str]], list[list[float]]], size: int = BATCH) -> DataFrame:
    """key and vector of each text by a model that takes a list of texts; an answer of another length is an error."""
    schema = chunks.select(key).schema.add("vector", ArrayType(FloatType()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), size):
                part = batch.iloc[lo : lo + size]
                vectors = model(part["__text"].fillna("").tolist())
                if len(vectors) != len(part):
                    raise ValueError(f"{len(part)} texts gave {len(vectors)} vectors")
                yield pd.DataFrame({key: part[key].to_numpy(), "vector": list(vectors)})

    return chunks.select(key, F.col(text).alias("__text")).mapInPandas(run, schema)


def citation_catalog(hits: DataFrame, request: str, order: list[Column], chunk: str) -> DataFrame:
    """request, chunk and cited: c_1, c_2 ... by the first place of each chunk among a request's hits."""
    placed = hits.withColumn("__at", F.row_number().over(Window.partitionBy(request).orderBy(*order)))
    first = placed.groupBy(request, chunk).agg(F.min("__at").alias("__at"))
    number = F.row_number().over(Window.partitionBy(request).orderBy("__at"))
    return first.select(request, chunk, F.concat(F.lit("c_"), number).alias("cited"))


def language_rule(languages: Column) -> Column:
    """none, one or several: which instruction for search queries a scope's languages call for."""
    n = F.size(languages)
    return F.when(n == 0, "the question's language").when(n == 1, F.concat(F.lit("only "), F.element_at(languages, 1))).otherwise(F.concat(F.lit("English first, of "), F.array_join(languages, ", ")))


# ---- editions ----


def bilingual_step(kind: Column, status: Column, has_texts: Column, pair_job: Column, paired: Column, current: Column, link_job: Column, matched: Column, linked: Column) -> Column:
    """Where a chapter's two-language edition stands."""
    busy = lambda job: F.coalesce(job.isin("queued", "running"), F.lit(False))
    fresh = F.coalesce(paired & current, F.lit(False))
    return first_rule(
        [
            (F.coalesce(kind != "translation", F.lit(True)), "no-translation"), (status.isin("pending", "translating"), "translating"), (status == "suspended", "translation-stopped"), (status == "failed", "translation-failed"),
            (~has_texts, "no-text"), (busy(pair_job), "pairing"), (~fresh & (pair_job == "failed"), "pair-failed"), (~fresh & F.coalesce(paired, F.lit(False)), "outdated"), (~fresh, "unpaired"),
            (busy(link_job), "linking"), ((matched > 0) & (linked >= matched), "linked"),
        ],
        "paired",
    )


def readiness(chapters: DataFrame, by: str, name: Column, done: Column, paired: Column, linked: Column, order: Column | None = None) -> DataFrame:
    """Per edition: how many chapters are selected, paired and linked, and which are not translated, paired or linked yet, in the order given (else by name)."""
    at = F.struct((name if order is None else order).alias("at"), name.alias("name"))
    names = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(c, at))), lambda x: x["name"]), ",")
    return chapters.groupBy(by).agg(
        F.count("*").alias("selected"), F.count_if(paired).alias("paired"), F.count_if(paired & linked).alias("linked"),
        names(~done).alias("untranslated"), names(done & ~paired).alias("unpaired"), names(paired & ~linked).alias("unlinked"),
    )


def current_references(stored: DataFrame, texts: DataFrame, key: str) -> DataFrame:
    """Rows of stored (source_hash, target_hash) whose hashes are those of the present trimmed texts (source, target)."""
    same = (F.sha2(F.trim("source"), 256) == F.col("source_hash")) & (F.sha2(F.trim("target"), 256) == F.col("target_hash"))
    return stored.join(texts, key).where(same).select(stored.columns)


def violations(pairs: DataFrame, unit: str, order: str) -> DataFrame:
    """Pairs (start, end, length, status) that break the rules of a two-language text: unit, order and rule."""
    before = F.max("end").over(Window.partitionBy(unit).orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    line = pairs.withColumn("__before", before)
    has = F.col("start").isNotNull()
    rules = [
        ("overlap", has & (F.col("start") < F.col("__before"))), ("empty", has & (F.col("end") <= F.col("start"))), ("outside", has & ((F.col("start") < 0) | (F.col("end") > F.col("length")))),
        ("no-range", ~has & (F.col("status") == "matched")), ("range", has & (F.col("status") == "missing")),
    ]
    broken = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules]))
    return line.select(unit, order, F.explode(broken).alias("rule"))


def link_batches(pairs: DataFrame, unit: str, order: str, size: str, *, most: int = 5000, longest: int = 12_000) -> DataFrame:
    """unit, order and batch (from 0): pairs in order, a new batch where the size would pass `most`; one longer than `longest` is an error."""
    safe = F.when(F.col(size) > longest, F.raise_error(F.lit("a passage is too long to link")).cast("long")).otherwise(F.col(size).cast("long"))
    rows = pairs.select(F.col(unit).alias("u"), F.col(order).cast("long").alias("o"), F.coalesce(safe, F.lit(0)).alias("n"))
    rows = rows.repartition("u").sortWithinPartitions("u", "o", "n")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, at, number, held = False, None, 0, 0
        for batch in batches:
            out = []
            for key, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or key != at:
                    begun, at, number, held = True, key, 0, 0
                if held > 0 and held + n > most:
                    number, held = number + 1, 0
                held += n
                out.append(number)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.int32())], [unit, order, "batch"])

    return rows.mapInArrow(run, f"`{unit}` {rows.schema['u'].dataType.simpleString()}, `{order}` bigint, batch int")


def reordered(files: DataFrame, wanted: DataFrame, unit: str, key: str) -> DataFrame:
    """unit, key and position of lists (wanted: unit, ids) that are a permutation of the unit's files; other lists change nothing."""
    asked = wanted.select(unit, F.posexplode("ids").alias("position", key))
    have = files.select(unit, key).withColumn("__have", F.lit(1))
    both = asked.join(have, [unit, key], "full").withColumn("__twice", F.count("*").over(Window.partitionBy(unit, key)))
    bad = both.where("position IS NULL OR __have IS NULL OR __twice > 1").select(unit).distinct()
    return asked.join(bad, unit, "left_anti")


def whole_digests(files: DataFrame, unit: str, order: str, text: str, *, title: str = "# file ", between: str = "\n\n") -> DataFrame:
    """unit, chars, files and whole: the SHA-256 of a unit's files in order as one text, each under its own heading.

    One hash goes over all of a unit, so its files pass one task in order, a batch at a time; they are never gathered.
    """
    part = F.concat(F.lit(title), F.col(order).cast("string"), F.lit("\n"), F.coalesce(F.col(text), F.lit("")))
    rows = files.select(F.col(unit).alias("u"), F.col(order).alias("o"), part.alias("part"), F.coalesce(F.length(text), F.lit(0)).cast("long").alias("n"))
    rows = rows.repartition("u").sortWithinPartitions("u", "o")
    names = [unit, "chars", "files", "whole"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, chars, files_, kind = None, None, 0, 0, None
        for batch in batches:
            out, kind = [], batch.schema.field(0).type
            for key, part, n in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3))):
                if state is None or key != at:
                    if state is not None:
                        out.append((at, chars, files_, state.hexdigest()))
                    at, state, chars, files_ = key, hashlib.sha256(), 0, 0
                else:
                    state.update(between.encode())
                state.update(part.encode())
                chars, files_ = chars + n, files_ + 1
            yield _four(out, kind, names)
        if state is not None:
            yield _four([(at, chars, files_, state.hexdigest())], kind, names)

    return rows.mapInArrow(run, f"`{unit}` {rows.schema['u'].dataType.simpleString()}, chars bigint, files bigint, whole string")


def _four(rows: list[tuple], kind: pa.DataType, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (kind, pa.int64(), pa.int64(), pa.string()))], names)


# ---- pages ----


def pages_with_columns(lines: DataFrame, page: str, gap: float = 80) -> DataFrame:
    """page of pages where two lines (x0, y0, x1, y1) share some height, with a gap between them.

    A sweep down each page: lines come in the order of their tops, and of those that reach the current top only the
    leftmost right edge and the rightmost left edge matter.
    """
    rows = lines.where("y1 > y0").select(page, *[F.col(c).cast("double").alias(c) for c in ("y0", "y1", "x0", "x1")])
    rows = rows.repartition(page).sortWithinPartitions(page, "y0")

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: object = None
        begun = done = False
        right: list[tuple[float, float]] = []  # right edges, least first, with where the line ends
        left: list[tuple[float, float]] = []  # left edges, greatest first
        for batch in batches:
            out = []
            for key, y0, y1, x0, x1 in zip(*(c.to_pylist() for c in batch.columns)):
                if not begun or key != at:
                    at, begun, done, right, left = key, True, False, [], []
                if done:
                    continue
                heappush(right, (x1, y1))
                heappush(left, (-x0, y1))
                for heap in (right, left):
                    while heap[0][1] <= y0:
                        heappop(heap)
                if right[0][0] + gap < -left[0][0]:
                    out.append(key)
                    done = True
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(0).type)], [page])

    return rows.mapInArrow(found, rows.select(page).schema)


def routes(lines: DataFrame, page: str) -> DataFrame:
    """page and route: lines (id, text, x0, y0, x1, y1, on a scale of 1000) of plain prose go the standard way."""
    body = lines.where((F.trim("text") != "") & (F.col("y0") > 70) & (F.col("y1") < 900))
    per = body.groupBy(page).agg(
        F.count("*").alias("n"), F.count_if(F.col("x1") - F.col("x0") > 500).alias("wide"),
        F.count_if(F.rlike("text", F.lit(r"[.!?…][”’\"')\]]?\s*$"))).alias("ends"), F.bool_or(F.rlike("text", F.lit(r"^\s*\d{1,3}\s+\p{L}"))).alias("counters"),
    )
    beside = pages_with_columns(body, page).withColumn("columns", F.lit(True))
    simple = (F.col("n") >= 8) & F.col("columns").isNull() & ~F.col("counters") & (F.col("wide") / F.col("n") >= 0.75) & (F.col("ends") / F.col("n") < 0.5)
    known = lines.select(page).distinct().join(per, page, "left").join(beside, page, "left")
    return known.select(page, F.when(F.coalesce(simple, F.lit(False)), "standard").otherwise("ordered").alias("route"))


def is_garbled(engine: Column, low_share: Column) -> Column:
    """Whether a page's recognised text is not to be trusted."""
    return F.coalesce((engine == "tesseract") & (low_share >= 0.15), F.lit(False))


# Language packs by script, most common first.
PACKS = {
    "Latin": "eng fra deu spa ita por nld pol ces hun ron tur swe dan fin nor hrv slv slk vie ind", "Cyrillic": "bul rus ukr srp mkd bel", "Han": "chi_sim chi_tra jpn", "Japanese": "jpn", "Hangul": "kor",
    "Arabic": "ara fas urd", "Hebrew": "heb", "Greek": "ell", "Devanagari": "hin mar nep san", "Thai": "tha", "Armenian": "hye", "Georgian": "kat", "Bengali": "ben", "Tamil": "tam", "Telugu": "tel", "Kannada": "kan",
    "Malayalam": "mal", "Gujarati": "guj", "Gurmukhi": "pan", "Sinhala": "sin", "Khmer": "khm", "Lao": "lao", "Myanmar": "mya", "Tibetan": "bod", "Ethiopic": "amh tir", "Syriac": "syr", "Cherokee": "chr", "Fraktur": "frk deu",
}


def packs_for_script(script: Column) -> Column:
    """The language packs of a script; none for an unknown one."""
    table = F.create_map(*[x for s, p in PACKS.items() for x in (F.lit(s), F.lit(p))])
    return F.coalesce(F.split(F.try_element_at(table, script), " "), F.array().cast("array<string>"))


def page_groups(pages: DataFrame, unit: str, page: str, plain: Column) -> DataFrame:
    """unit, first, last and plain: runs of plain pages folded into one group, other pages each alone."""
    line = Window.partitionBy(unit).orderBy(page)
    rows = pages.withColumn("plain", plain)
    new = ~(F.col("plain") & F.coalesce(F.lag("plain").over(line), F.lit(False)))
    rows = rows.withColumn("__group", F.sum(new.cast("int")).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy(unit, "__group").agg(F.min(page).alias("first"), F.max(page).alias("last"), F.first("plain").alias("plain")).drop("__group")


def page_window(pages: DataFrame, unit: str, page: str, text: str, *, count: int = 15, most_page: int = 6000, most: int = 60_000) -> DataFrame:
    """unit, page and text of the first `count` pages, each cut to most_page characters, while they fit into most."""
    line = Window.partitionBy(unit).orderBy(page)
    rows = pages.withColumn("__n", F.row_number().over(line)).where(F.col("__n") <= count).withColumn(text, F.substring(text, 1, most_page))
    rows = rows.withColumn("__upto", F.sum(F.length(text)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.where(F.col("__upto") <= most).select(unit, page, text)


def merged_pages(a: DataFrame, b: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and text: of two readings of a page the one with more characters that are no blanks; the first, if equal."""
    dense = lambda c: F.length(F.regexp_replace(F.coalesce(c, F.lit("")), F.lit(r"\s+"), F.lit("")))
    both = a.select(*keys, F.col(text).alias("__a")).join(b.select(*keys, F.col(text).alias("__b")), keys, "full")
    return both.select(*keys, F.when(dense(F.col("__b")) > dense(F.col("__a")), F.col("__b")).otherwise(F.coalesce("__a", "__b")).alias(text))


def label_sized(chapters: DataFrame, unit: str, order: str, words: str, least: int = 120) -> DataFrame:
    """chapters with label_sized: under so many words, and not the last of the unit."""
    last = F.lead(order).over(Window.partitionBy(unit).orderBy(order)).isNull()
    return chapters.withColumn("label_sized", (F.col(words) < least) & ~last)


# ---- intake, jobs and sweeps ----


def api_errors(rows: DataFrame, key: str, title: Column, text: Column, *, most_title: int = 500, most_text: int = 5_000_000) -> DataFrame:
    """key and error of rows that an intake refuses."""
    found = F.array_compact(F.array(F.when(F.coalesce(F.trim(title), F.lit("")) == "", "no title"), F.when(F.length(title) > most_title, "long title"), F.when(F.coalesce(F.trim(text), F.lit("")) == "", "no text"), F.when(F.length(text) > most_text, "long text")))
    return rows.select(key, F.explode(found).alias("error"))


def recovery_sweep(jobs: DataFrame, status: str, tries: str, alive: Column, most_tries: int = 3) -> DataFrame:
    """Jobs that were running when their worker went, with the status they get: queued again, or failed after most_tries."""
    return jobs.where((F.col(status) == "running") & ~alive).withColumn(status, F.when(F.col(tries) < most_tries, "queued").otherwise("failed"))


def expired(rows: DataFrame, at: str, now: Column, hours: float) -> DataFrame:
    """Rows older than so many hours."""
    return rows.where(F.unix_micros(now) - F.unix_micros(at) > F.lit(int(hours * 3_600_000_000)))


def ready_outputs(outputs: DataFrame, inputs: DataFrame, key: str, settled: Column) -> DataFrame:
    """outputs with waiting, the count of their inputs that are not settled yet; 0 may start."""
    open_ = inputs.groupBy(key).agg(F.count_if(~settled).alias("waiting"))
    return outputs.join(open_, key, "left").withColumn("waiting", F.coalesce("waiting", F.lit(0)).cast("long"))


def append_rows(rows: DataFrame, path: str, batch: int = 200) -> None:
    """Append rows as Parquet files of at most `batch` rows each."""
    rows.write.option("maxRecordsPerFile", batch).mode("append").parquet(path)


# ---- filters of a chapter table ----

# The steps on the way to a two-language text that each choice stands for, and ages in days (from, to).
STEPS = {
    "needs-translation": ["no-translation", "translating", "translation-stopped", "translation-failed", "no-text"], "needs-pairing": ["unpaired", "outdated", "pair-failed", "pairing"],
    "readable": ["paired", "linking", "linked"], "needs-words": ["paired", "linking"], "linked": ["linked"],
}
AGES = {"day": (None, 1), "week": (None, 7), "older-week": (7, None), "older-month": (30, None)}
STALE = "stale"


def typed_bound(text: str | None) -> float | None:
    """A typed bound: a comma may be the decimal mark; nothing, a negative or no number is none, and 0 is one."""
    try:
        n = float((text or "").strip().replace(",", "."))
    except ValueError:
        return None
    return n if 0 <= n < float("inf") else None


def stale_narration(voice: Column, speed: Column, current: tuple[str, float]) -> Column:
    """Whether a chapter's audio was not made with the current voice and speed; audio of no known voice was not."""
    has = F.col("audio").isNotNull() & (F.col("audio") != "")
    other = F.coalesce(voice, F.lit("")) != current[0]
    return has & (other | F.coalesce(speed != current[1], F.lit(False)))


def chapter_filter(choice: dict, now: Column, current: tuple[str, float]) -> Column:
    """Whether a chapter is kept by a filter panel's choice; what is not chosen keeps all.

    choice: statuses (any of them), file, voice (a name, or STALE), step (of STEPS), age (of AGES) and typed bounds words_min, words_max, minutes_min,
    minutes_max. Chapters: status, words, duration_ms, file, audio, voice, speed, made_at, step. A date, voice or length belongs to audio: a
    chapter without audio has none.
    """
    has = F.col("audio").isNotNull() & (F.col("audio") != "")
    rules = []
    if choice.get("statuses"):
        rules.append(F.col("status").isin(choice["statuses"]))
    if choice.get("file") is not None:
        rules.append(F.col("file") == choice["file"])
    if choice.get("voice") == STALE:
        rules.append(has & stale_narration(F.col("voice"), F.col("speed"), current))
    elif choice.get("voice"):
        rules.append(has & (F.col("voice") == choice["voice"]))
    if choice.get("step"):
        rules.append(F.col("step").isin(STEPS[choice["step"]]))
    if choice.get("age"):
        least, most = AGES[choice["age"]]
        seconds = F.unix_micros(now) - F.unix_micros(F.col("made_at"))
        day = 86_400_000_000
        rules += [has, seconds >= least * day if least is not None else seconds < most * day]
    for column, name in ((F.col("words"), "words"), (F.col("duration_ms") / 60_000, "minutes")):
        least, most = typed_bound(choice.get(f"{name}_min")), typed_bound(choice.get(f"{name}_max"))
        if name == "minutes" and (least is not None or most is not None):
            rules += [has, F.col("duration_ms").isNotNull()]
        rules += [column >= least] * (least is not None) + [column <= most] * (most is not None)
    keep = F.lit(True)
    for rule in rules:
        keep &= F.coalesce(rule, F.lit(False))
    return keep


def active_filters(choice: dict) -> int:
    """How many of a panel's filters are in use; a pair of bounds is one."""
    bounds = [any(typed_bound(choice.get(f"{name}_{side}")) is not None for side in ("min", "max")) for name in ("words", "minutes")]
    return sum([bool(choice.get("statuses")), choice.get("file") is not None, *(bool(choice.get(k)) for k in ("voice", "age", "step")), *bounds])
