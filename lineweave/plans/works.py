"""Work-level plans: scripts, glossaries and prompts' context of each work."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import strip, without_brackets
from ..operators.cut import checkpointed
from ..operators.matching import held_names, merge_terms
from ..operators.scripts import characters, coverage, is_free_talk
from ..operators.windows import first_rows, stride_sample, within_budget


def cached_scripts(json_caches: DataFrame, split_files: DataFrame, tracks: DataFrame) -> DataFrame:
    """Lines of all tracks from earlier exports, per work.

    json_caches(work, content map of track to lines) count if a name matches and anything is in them;
    else split_files(work, stem, content) if they are at least half as many as the tracks, by
    containment of names, then by the first four letters.  tracks(work, track, seq).  Names meet on equal parts
    and the first track of each four letters, so a work of many tracks makes no pairs of all names.
    """
    none = F.array().cast("array<string>")
    cached = json_caches.select("work", F.explode(F.from_json("content", "map<string,array<string>>")).alias("track", "lines"))
    known = cached.join(tracks.select("work", "track").hint("shuffle_hash"), ["work", "track"], "left_semi").select("work").distinct()
    full = cached.filter(F.size("lines") > 0).select("work").distinct().join(known, "work", "left_semi")
    full = checkpointed(full)  # steps that several others read are written once; sizes of compressed files tell little of rows, hence the hints
    first = tracks.join(full, "work", "left_semi").join(cached.hint("shuffle_hash"), ["work", "track"], "left").select("work", "track", F.coalesce("lines", none).alias("lines"))

    left = checkpointed(tracks.join(full, "work", "left_anti"))
    wanted = left.groupBy("work").agg(F.count("*").alias("n"))
    enough = split_files.groupBy("work").agg(F.count("*").alias("m")).join(wanted, "work").filter("m >= n * 0.5").select("work")
    enough = checkpointed(enough)
    some = checkpointed(split_files.join(enough, "work", "left_semi"))
    stems, names = some.select("work", F.col("stem").alias("name")).distinct(), left.select("work", F.col("track").alias("name")).distinct()
    as_holders = lambda df: df.withColumnRenamed("name", "holder")
    held = held_names(stems, as_holders(names), ("work",)).select("work", F.col("name").alias("stem"), F.col("holder").alias("track"))
    held = held.unionByName(held_names(names, as_holders(stems), ("work",)).select("work", F.col("holder").alias("stem"), F.col("name").alias("track")))
    held = held.join(left.select("work", "track", "seq").hint("shuffle_hash"), ["work", "track"]).select("work", "stem", "track", F.lit(0).alias("tier"), "seq")
    four = lambda c: F.left(c, F.lit(4)).alias("four")
    heads = left.groupBy("work", four("track")).agg(F.min_by(F.struct("track", "seq"), "seq").alias("t"))
    alike = stems.select("work", F.col("name").alias("stem"), four("name")).join(heads.hint("shuffle_hash"), ["work", "four"]).select("work", "stem", "t.track", F.lit(1).alias("tier"), "t.seq")
    met = held.unionByName(alike).groupBy("work", "stem").agg(F.min_by("track", F.struct("tier", "seq")).alias("track"))
    best = some.join(met.hint("shuffle_hash"), ["work", "stem"]).select("work", "stem", F.struct("track", "content").alias("b"))
    lines = F.filter(F.transform(F.split("b.content", "\n"), lambda x: strip(x)), lambda x: x != "")
    got = best.groupBy("work", F.col("b.track").alias("track")).agg(F.max_by(lines, "stem").alias("lines"))
    second = left.join(enough, "work", "left_semi").join(got.hint("shuffle_hash"), ["work", "track"], "left").select("work", "track", F.coalesce("lines", none).alias("lines"))
    return first.unionByName(second)


def accepted_cache(cached: DataFrame) -> DataFrame:
    """Only works whose cache covers at least three tracks in ten."""
    return cached.join(coverage(cached).filter("accepted").select("work"), "work", "left_semi")


def asr_samples(cues: DataFrame, n: int = 15) -> DataFrame:
    """Rows (track, text): the first lines with text of each track.  cues(track, seq, text)."""
    lines = first_rows(cues.withColumn("text", strip("text")).filter("text <> ''"), n, "track")
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))
    return lines.groupBy("track").agg(F.array_join(F.transform(ordered, lambda x: x["text"]), "\n").alias("text"))


def world_sample(lines: DataFrame, per_file: int = 40, most_chars: int = 5000) -> DataFrame:
    """W13 then W10: evenly spaced lines of every file of a work, up to a number of characters.

    lines(work, file, seq, text).
    """
    spaced = stride_sample(lines.filter(strip("text") != ""), per_file, "file")
    n = F.row_number().over(Window.partitionBy("work").orderBy("file", "seq"))
    return within_budget(spaced.withColumn("seq", n), most_chars, "work")


def world_of_files(files: DataFrame) -> DataFrame:
    """Rows (work, worldview, scene) from files(work, name, priority, content).

    Later candidates override earlier ones; ``.worldview.json`` only fills what is blank.
    """
    field = lambda names: F.coalesce(*[F.nullif(F.get_json_object("content", f"$.{n}"), F.lit("")) for n in names], F.col("content"))
    is_json, hidden = F.endswith("name", F.lit(".json")), F.col("name") == ".worldview.json"
    kind = F.when(hidden | F.rlike("name", F.lit("^(worldview|world_setting|world|世界观)\\.")), "worldview").when(F.rlike("name", F.lit("^(scene|setting|场景)\\.")), "scene")
    value = F.when(kind == "scene", F.when(is_json, field(("scene", "description", "text"))).otherwise(F.col("content"))).otherwise(F.when(is_json, field(("worldview", "description", "text"))).otherwise(F.col("content")))
    rows = files.withColumns({"kind": kind, "value": strip(value), "rank": F.when(hidden, -1).otherwise(F.col("priority"))}).filter("kind is not null and value <> ''")
    return rows.groupBy("work").agg(F.max_by(F.when(F.col("kind") == "worldview", F.col("value")), F.when(F.col("kind") == "worldview", F.col("rank"))).alias("worldview"), F.max_by(F.when(F.col("kind") == "scene", F.col("value")), F.when(F.col("kind") == "scene", F.col("rank"))).alias("scene"))


def work_terms(own: DataFrame, worlds: DataFrame, shared: DataFrame | None = None, asked: DataFrame | None = None) -> DataFrame:
    """terms(work, src, tgt): own, then characters of the world, its special terms, global ones.

    worlds(work, content) are JSON documents; bracketed notes are cut from names.  shared(src, tgt) is the
    global glossary, a table joined by source word to asked(work, src), the words that works look up; so
    no work carries a copy of it.
    """
    people = characters(worlds).select("work", strip("name").alias("src"), without_brackets("name_cn").alias("tgt"))
    special = worlds.select("work", F.explode(F.from_json(F.get_json_object("content", "$.special_terms"), "map<string,string>")).alias("src", "tgt")).select("work", strip("src").alias("src"), without_brackets("tgt").alias("tgt"))
    full = lambda df: df.filter("src <> '' and tgt <> ''")
    mine = merge_terms(own, full(people), full(special))
    if shared is None:
        return mine
    # A shared term holds for every work that names it in its texts: the pairs are asked for, never multiplied.
    held = asked.join(shared, "src").select("work", "src", "tgt")
    return merge_terms(mine, held)


def needs_world(works: DataFrame) -> DataFrame:
    """Works whose path is no free talk, for which an analysis is asked.  works(work, path)."""
    return works.filter(~is_free_talk(F.col("path")))


def with_context(rows: DataFrame, terms: DataFrame, most: int = 30) -> DataFrame:
    """Add to rows(work, ...) at most so many terms of their work, in order of the source."""
    n = F.row_number().over(Window.partitionBy("work").orderBy("src"))
    listed = terms.withColumn("n", n).filter(F.col("n") <= most).groupBy("work").agg(F.array_sort(F.collect_list(F.concat("src", F.lit("→"), "tgt"))).alias("terms"))
    return rows.join(listed, "work", "left")


def directory_answers(answers: DataFrame, files: DataFrame) -> DataFrame:
    """M3: rows (file, seq, text) for every line of files(dir, file, n) from answers(dir, raw).

    ``raw`` maps file names to lists of ``{index, text}``; what is missing stays blank.
    """
    got = answers.select("dir", F.explode(F.from_json("raw", "map<string,array<struct<index:int,text:string>>>")).alias("file", "items")).select("dir", "file", F.explode("items").alias("i")).select("dir", "file", F.col("i.index").alias("seq"), F.col("i.text").alias("text"))
    every = files.select("dir", "file", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("seq"))
    return every.join(got.dropDuplicates(["dir", "file", "seq"]), ["dir", "file", "seq"], "left").select("dir", "file", "seq", F.coalesce("text", F.lit("")).alias("text"))
