"""Joins that are not plain equalities.

Each is a hash join on a coarse key followed by the exact condition; none is a nested loop over two
large tables.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.window import Window

from ..functions.names import name_key
from ..functions.nested import let, running
from ..functions.text import bigrams, compact, dice, strip
from .cut import checkpointed

NEAR_MS, LONGEST_MS = 80, 60_000


def first_free(pairs: DataFrame) -> DataFrame:
    """Cues of a file take, in order of seq, their first segment (by rank, then seg) that no earlier cue took.

    pairs(file, seq, rank, seg).  Where a cue's first choice has no earlier cue that could take it, the two
    belong together whatever the others do; all such pairs leave at once, with every other pair of theirs,
    and the rest goes on.  The first cue left always finds its segment, so this ends; the rounds are as many
    as cues of one text compete in a row.
    """
    out, rest = None, checkpointed(pairs)
    while True:
        wish = rest.groupBy("file", "seq").agg(F.min(F.struct("rank", "seg")).alias("m")).select("file", "seq", "m.seg")
        heir = rest.groupBy("file", "seg").agg(F.min("seq").alias("seq"))
        taken = checkpointed(wish.join(heir, ["file", "seg", "seq"]).select("file", "seq", "seg"))
        out = taken if out is None else out.unionByName(taken)
        rest = checkpointed(rest.join(taken.select("file", "seq"), ["file", "seq"], "left_anti").join(taken.select("file", "seg"), ["file", "seg"], "left_anti"))
        if rest.isEmpty():
            return out


def match_segments(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """Rows (file, seq, seg): start within 80 ms and equal text without blanks, each segment once.

    Joined on file, text and 80-ms bucket, so only real candidates meet.
    """
    bucket = lambda c: F.floor(c / NEAR_MS)
    c = cues.select("file", "seq", "time_ms", compact("text").alias("key"), F.posexplode(F.array(*[bucket(F.col("time_ms")) + d for d in (-1, 0, 1)])).alias("rank", "bucket"))
    s = segments.filter("start >= 0").select("file", "seg", "start", compact("text").alias("key"), bucket(F.col("start")).alias("bucket"))
    near = c.join(s, ["file", "key", "bucket"]).filter(F.abs(F.col("start") - F.col("time_ms")) <= NEAR_MS)
    return first_free(near.select("file", "seq", "rank", "seg"))


def as_of_segments(cues: DataFrame, segments: DataFrame, nearest: bool = False) -> DataFrame:
    """Rows (file, seq, seg, words) for cues inside a longer segment.

    The segment starts at most 60 s before the cue and ends no earlier than 80 ms before it; the latest
    such segment counts whose words hold the cue's text as a run starting near the cue.  Where each word
    starts in a segment's letters is summed once: a run begins at a word whose letters go on with the
    text, and ends where another word starts.  Of several runs in a segment the first counts, or, if asked for,
    the one that starts nearest to the cue (the later of equally near ones).
    """
    bucket = lambda c: F.floor(c / LONGEST_MS)
    c = cues.select("file", "seq", "time_ms", compact("text").alias("key"), F.explode(F.array(bucket(F.col("time_ms")), bucket(F.col("time_ms")) - 1)).alias("bucket")).filter("key <> ''")
    s = segments.select(
        "file", "seg", "start", "end", "words", bucket(F.col("start")).alias("bucket"), F.transform("words", lambda w: w["start"]).alias("begins"),
        running(F.col("words"), lambda w: F.length(compact(w["word"]))).alias("sums"), compact(F.array_join(F.transform("words", lambda w: F.coalesce(w["word"], F.lit(""))), "")).alias("letters"),
    )
    inside = c.join(s, ["file", "bucket"]).filter((F.col("start") <= F.col("time_ms")) & (F.col("start") >= F.col("time_ms") - LONGEST_MS) & (F.col("end") >= F.col("time_ms") - NEAR_MS))
    n = F.length("key")
    stop = lambda a: F.array_position("sums", F.get("sums", a) + n)
    starts = lambda a: (F.abs(F.get("begins", a) - F.col("time_ms")) <= NEAR_MS) & (F.substring(F.col("letters"), F.get("sums", a) + 1, n) == F.col("key")) & (stop(a) > 0)
    places = F.when(F.contains("letters", "key") & (F.size("words") > 0), F.sequence(F.lit(0), F.size("words") - 1))
    fits = F.filter(places, starts)
    far = lambda a: F.struct(F.abs(F.get("begins", a) - F.col("time_ms")).alias("far"), (-a).alias("less"))
    place = -F.array_min(F.transform(fits, far))["less"] if nearest else F.get(fits, F.lit(0))
    first = let(place, lambda a: F.slice("words", a + 1, (stop(a) - 1 - a).cast("int")))
    runs = inside.select("file", "seq", "seg", "start", first.alias("run"))
    return runs.groupBy("file", "seq").agg(F.max_by(F.struct("seg", F.col("run").alias("words")), F.when(F.col("run").isNotNull(), F.struct("start", "seg"))).alias("best")).filter("best is not null").select("file", "seq", "best.*")


def cue_words(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """J5 then J6: rows (file, seq, words) for every cue that word timing is found for."""
    whole = match_segments(cues, segments).join(segments.select("file", "seg", "words"), ["file", "seg"])
    left = cues.join(whole.select("file", "seq"), ["file", "seq"], "left_anti")
    return whole.select("file", "seq", "words").unionByName(as_of_segments(left, segments).select("file", "seq", "words"))


def segments_fit(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """P20: per file, as many segments as cues, and first, middle and last start within 80 ms."""
    c = cues.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seq", "time_ms"))).alias("c"))
    s = segments.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("seg", "start"))).alias("s"))
    n = F.size("s")
    near = lambda i: F.abs(F.element_at("s", i)["start"] - F.element_at("c", i)["time_ms"]) <= NEAR_MS
    fits = F.when((F.size("c") == n) & (n > 0), near(F.lit(1)) & near(F.floor(n / 2).cast("int") + 1) & near(n)).otherwise(False)
    return c.join(s, "file").select("file", fits.alias("fits"))


# --- fuzzy and tiered names ------------------------------------------------------------------------------


#: Lines of a script that are scored at once.
AT_ONCE = 512


class _Samples:
    """Sample lines of a group as the columns of a table: which of their bigrams, by code, each one holds."""

    def __init__(self, rows):
        self.size = np.array([len(r.grams) for r in rows])
        codes = [_pair_codes(g) for r in rows for g in r.grams]
        self.codes, at = np.unique(np.array(codes, np.int64), return_inverse=True)
        self.holds = np.zeros((len(self.codes), len(rows)), np.uint8)
        self.holds[at, np.repeat(np.arange(len(rows)), self.size)] = 1

    def scores(self, texts: list[str]) -> np.ndarray:
        """Dice of each line with every sample."""
        letters = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        line = np.repeat(np.arange(len(texts)), [len(x) for x in texts])
        pairs = (line[:-1] << 42 | letters[:-1] << 21 | letters[1:])[line[:-1] == line[1:]]
        pairs = np.unique(pairs)
        line, codes = pairs >> 42, pairs & ((1 << 42) - 1)
        size = np.bincount(line, minlength=len(texts))
        at = np.searchsorted(self.codes, codes)
        known = self.codes[np.minimum(at, len(self.codes) - 1)] == codes
        line, at = line[known], at[known]
        used, at = np.unique(at, return_inverse=True)
        if len(used) * len(texts) <= 16 * len(at):  # lines share most of their bigrams: one product of matrices
            has = np.zeros((len(texts), len(used)), np.float32)
            has[line, at] = 1
            shared = (has @ self.holds[used].astype(np.float32)).astype(np.float64)
        else:
            ends = np.searchsorted(line, np.arange(len(texts) + 1))
            shared = np.array([self.holds[used[at[i:j]]].sum(0, dtype=np.uint32) for i, j in zip(ends, ends[1:], strict=False)])
        return 2.0 * shared / (self.size + size[:, None])


def _pair_codes(gram: str) -> int:
    return ord(gram[0]) << 21 | ord(gram[1])


def anchors(samples: DataFrame, script: DataFrame, first: int = 5, longer_than: int = 8, least: float = 0.5, by: tuple[str, ...] = (), group: int = 2048) -> DataFrame:
    """Rows (track, *by, anchor): where a track's first lines stand in a script.

    samples(track, seq, text), script(*by, line_no, text), ``by`` telling scripts apart.  Each of the first
    lines takes the line of a script with the best Dice score (the earliest of equals) if it reaches
    ``least``; the anchor is the median of their numbers, cut to an integer.

    Only the samples are indexed, by bigram, in groups of ``group`` lines, each small enough to go to all
    tasks; lines of the script are read once for a group and ``AT_ONCE`` of them scored with the whole group
    at a time.  Of lines of one script that a task reads together, only the best of each sample, if it reaches
    ``least``, is shuffled, once.  (At a score of one half a prefix filter would
    let two thirds of a line's bigrams through, so nearly every pair would meet.)
    """
    lines = samples.withColumn("text", strip("text")).filter(F.length("text") > longer_than)
    lines = lines.withColumn("n", F.row_number().over(Window.partitionBy("track").orderBy("seq"))).filter(F.col("n") <= first)
    lines = lines.select("track", "n", bigrams("text").alias("grams"))
    numbered = checkpointed(lines.withColumn("part", F.pmod(F.xxhash64("track", "n"), F.lit(max(1, -(-lines.count() // group))))))
    other = script.select(*by, "line_no", strip("text").alias("text")).filter(F.length("text") > 1)
    kinds = dict(numbered.dtypes) | dict(other.dtypes)
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("track", "n", *by, "line_no")) + ", score double"
    tracks = {f.name: f.dataType for f in numbered.schema}["track"]

    def scored(rows) -> DataFrame:
        """Rows of the script that reach the score with a sample of a group (at most ``group`` lines or so)."""
        index, names, places = _Samples(rows), [r.track for r in rows], [r.n for r in rows]
        track_type = to_arrow_type(tracks)

        def run(batches):
            for batch in batches:
                texts, numbers = batch.column("text").to_pylist(), batch.column("line_no").to_pylist()
                keys = list(zip(*(batch.column(c).to_pylist() for c in by), strict=True)) or [()] * len(texts)
                script = np.cumsum([i > 0 and keys[i] != keys[i - 1] for i in range(len(keys))])
                order = sorted(range(len(texts)), key=lambda i: (script[i], numbers[i] is None, numbers[i] or 0))
                for start in range(0, len(order), AT_ONCE):
                    rows = np.array(order[start : start + AT_ONCE])
                    score = index.scores([texts[i] for i in rows])
                    edges = [*np.flatnonzero(np.diff(script[rows], prepend=-1)), len(rows)]
                    found = [np.zeros((3, 0))]
                    for i, j in zip(edges, edges[1:], strict=False):
                        best = score[i:j].argmax(0)  # the earliest line of equals
                        reached = score[i + best, np.arange(score.shape[1])]
                        who = np.flatnonzero(reached >= least)
                        found.append(np.array([who, rows[i + best[who]], reached[who]]))
                    who, at, reached = np.concatenate(found, 1)
                    who, at = pa.array(who.astype(np.int64)), pa.array(at.astype(np.int64))
                    columns = [pa.array(names, track_type).take(who), pa.array(places, pa.int32()).take(who)]
                    columns += [batch.column(c).take(at) for c in (*by, "line_no")] + [pa.array(reached)]
                    yield pa.RecordBatch.from_arrays(columns, ["track", "n", *by, "line_no", "score"])

        return other.mapInArrow(run, schema)

    met = None
    for part in [r.part for r in numbered.select("part").distinct().orderBy("part").collect()]:
        some = scored(numbered.filter(F.col("part") == part).collect())
        met = some if met is None else met.unionByName(some)
    if met is None:
        met = other.select(F.lit(None).cast(kinds["track"]).alias("track"), F.lit(0).alias("n"), *by, "line_no", F.lit(0.0).alias("score")).limit(0)
    met = met.repartition("track", *by)  # one shuffle for both groupings
    best = met.groupBy("track", "n", *by).agg(F.max_by("line_no", F.struct("score", -F.col("line_no"))).alias("line_no"))
    return best.groupBy("track", *by).agg(F.median("line_no").cast("long").alias("anchor"))


def held_names(names: DataFrame, holders: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Rows (*by, name, holder): distinct names(*by, name) inside names of distinct holders(*by, holder), equal in ``by``.

    Each part of a holder that is as long as some name is looked up by a plain equality, so no pairs are formed but
    those that hold: a holder of n letters looks up at most n parts for each length of names.  Empty names are in none.
    """
    lengths = [r[0] for r in names.select(F.length("name").alias("n")).filter("n > 0").distinct().orderBy("n").collect()]  # lengths of names, not names
    sized = holders.select(*by, "holder", F.explode(F.array(*[F.lit(n) for n in lengths]).cast("array<int>")).alias("n")).filter(F.length("holder") >= F.col("n"))
    places = F.sequence(F.lit(1), F.length("holder") - F.col("n") + 1)
    held = sized.select(*by, "holder", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("holder"), i, F.col("n"))))).alias("name"))
    # Names are distinct, so the hash table of each partition holds its share of them; the looked up parts stream by.
    return held.join(names.select(*by, "name").hint("shuffle_hash"), [*by, "name"]).select(*by, "name", "holder")


def tiered_names(wanted: DataFrame, have: DataFrame, compose: bool = False) -> DataFrame:
    """Rows (name, seq, match, tier): equal keys first, else the first key that holds or is held.

    wanted(name, seq), have(match, match_seq).  Names of one key are looked for once, and of names that share a key
    the first counts.  Containment only looks at keys that equality left over.
    """
    # Steps that several others read are written once.  Sizes of compressed files tell little of keys, hence the hints.
    w = wanted.select("name", "seq", name_key(F.col("name"), compose).alias("key"))
    h = have.select(name_key(F.col("match"), compose).alias("match_key"), F.struct("match_seq", "match").alias("m")).filter("match_key <> ''")
    h = checkpointed(h.groupBy("match_key").agg(F.min("m").alias("m")))
    keys = w.filter("key <> ''").select("key").distinct()
    exact = checkpointed(keys.join(h.hint("shuffle_hash"), F.col("key") == F.col("match_key"), "left").select("key", "m"))
    rest, theirs = exact.filter("m is null").select("key"), h.select("match_key")
    inside = held_names(rest.select(F.col("key").alias("name")), theirs.select(F.col("match_key").alias("holder"))).select(F.col("name").alias("key"), F.col("holder").alias("match_key"))
    around = held_names(theirs.select(F.col("match_key").alias("name")), rest.select(F.col("key").alias("holder"))).select(F.col("holder").alias("key"), F.col("name").alias("match_key"))
    first = inside.unionByName(around).join(h.hint("shuffle_hash"), "match_key").groupBy("key").agg(F.min("m").alias("m"))
    best = exact.filter("m is not null").withColumn("tier", F.lit(1)).unionByName(first.withColumn("tier", F.lit(2)))
    return w.join(best.hint("shuffle_hash"), "key", "left").select("name", "seq", "m.match", "tier")


def inherit_variants(tracks: DataFrame) -> DataFrame:
    """tracks(work, track, lines array) without lines take those of the name without its brackets."""
    base = F.regexp_replace("track", "[（(][^）)]*[）)]", "")
    t = tracks.withColumn("base", F.trim(base))
    full = tracks.filter(F.size("lines") > 0).select("work", F.col("track").alias("base"), F.col("lines").alias("base_lines"))
    joined = t.join(full, ["work", "base"], "left")
    return joined.select("work", "track", F.when(F.size("lines") > 0, F.col("lines")).otherwise(F.coalesce("base_lines", "lines")).alias("lines"))


def longest_prefix(rows: DataFrame, column: str, entries: DataFrame) -> DataFrame:
    """Add ``entry``, that of the longest key (case-insensitive) that the value starts with.

    entries(key, entry).  Joined on (length, prefix of that length): one probe for each distinct key
    length, so the dimension may be of any size.
    """
    e = entries.select(F.lower("key").alias("_key"), F.length("key").alias("_n"), "entry")
    sizes = [r[0] for r in e.select("_n").distinct().orderBy("_n").collect()]  # lengths of names, not names
    values = rows.select(column).distinct()
    probes = values.select(column, F.explode(F.array(*[F.lit(n) for n in sizes]).cast("array<int>")).alias("_n")).filter(F.length(column) >= F.col("_n"))
    probes = probes.withColumn("_key", F.lower(F.substring(F.col(column), F.lit(1), F.col("_n"))))
    best = probes.join(e, ["_n", "_key"]).groupBy(column).agg(F.max_by("entry", "_n").alias("entry"), F.max_by("_key", "_n").alias("matched_key"))
    return rows.join(best, column, "left")


def merge_terms(*sources: DataFrame) -> DataFrame:
    """terms(work, src, tgt) where earlier sources win and later ones fill what is missing."""
    out = None
    for i, s in enumerate(sources):
        s = s.select("work", "src", "tgt", F.lit(i).alias("priority"))
        out = s if out is None else out.unionByName(s)
    return out.groupBy("work", "src").agg(F.min_by("tgt", "priority").alias("tgt"))


def fill_missing(primary: DataFrame, other: DataFrame, tracks: DataFrame, share: float = 0.5) -> DataFrame:
    """Lines of all tracks; where the primary covers under ``share`` of a work's tracks, empty
    ones take the other's.  All have (work, track, lines), tracks (work, track)."""
    none = F.array().cast("array<string>")
    joined = tracks.join(primary.withColumnRenamed("lines", "p"), ["work", "track"], "left").join(other.withColumnRenamed("lines", "o"), ["work", "track"], "left")
    joined = joined.withColumns({"p": F.coalesce("p", none), "o": F.coalesce("o", none)})
    covered = F.avg((F.size("p") > 0).cast("double")).over(Window.partitionBy("work"))
    return joined.withColumn("c", covered).select("work", "track", F.when((F.size("p") == 0) & (F.col("c") < share), F.col("o")).otherwise(F.col("p")).alias("lines"))


def track_number(stem: Column) -> Column:
    """The number in a track name: with a word for track, a leading ``#n``, else two digits."""
    digits = F.translate(stem, "０１２３４５６７８９", "0123456789")
    named = F.regexp_extract(digits, r"(?i)(?:トラック|track|tr|トラ)[\s_．.\-]*([0-9]+)", 1)
    lead = F.regexp_extract(digits, r"^[#＃]?([0-9]+)(?:[\s_．.\-]|$)", 1)
    two = F.regexp_extract(digits, r"([0-9]{2})", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(lead, F.lit("")), F.nullif(two, F.lit(""))).try_cast("int")


def files_to_tracks(files: DataFrame, tracks: DataFrame) -> DataFrame:
    """Rows (path, track): the first track of a work with the file's number.

    Tracks of a number are folded to their first one before files meet them, so a work of many makes no pairs of all.
    """
    f = files.withColumn("n", track_number(F.col("stem")))
    t = tracks.withColumn("n", track_number(F.col("track"))).groupBy("work", "n").agg(F.min_by(F.struct("seq", "track"), "seq").alias("t"))
    return f.join(t.hint("shuffle_hash"), ["work", "n"]).groupBy("work", "path").agg(F.min_by("t.track", "t.seq").alias("track"))


def presplit_works(files: DataFrame, share: float = 0.5) -> DataFrame:
    """Per work, whether at least half of the stems carry a track number."""
    has = F.rlike("stem", F.lit(r"(?i)(?:トラック|track|tr|トラ)[\s_．.\-]*[０-９0-9]+|^[#＃]?[０-９0-9]+(?:[\s_．.\-]|$)"))
    return files.groupBy("work").agg((F.avg(has.cast("double")) >= share).alias("presplit"))


def same_reading(terms: DataFrame, reading: Column | None = None) -> DataFrame:
    """Terms grouped by equal readings; ``nth`` puts groups of two and more first; no reading, no group (Q12)."""
    key = reading if reading is not None else F.concat(F.lit("\0"), "src")
    groups = terms.groupBy("work", key.alias("reading")).agg(F.sort_array(F.collect_list(F.struct("line_no", "src", "tgt"))).alias("members"))
    groups = groups.withColumns({"single": F.size("members") < 2, "first_seen": F.get("members", F.lit(0))["line_no"]})
    return groups.withColumn("nth", F.row_number().over(Window.partitionBy("work").orderBy("single", "first_seen")))
