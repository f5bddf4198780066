"""Splitting over-long cues at legal places.

cue_tokens(file, seq, text, words array<struct<start,end,word>>[, morphemes, proposed]).  Everything is a
column expression: a table of a cue's cuts, and folds over it for the path search.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import sheet_label
from ..functions.nested import let, pairs_of, running
from ..functions.text import compact
from ..functions.timing import is_too_long
from .cut import checkpointed

# Limits of the segmenter.
SAFE_GAP, HARD_GAP, CLEAR_GAP = 300, 800, 800
LEAST_CHARS, LEAST_GAP_CHARS = 2, 3
CUT_COST, OVER_COST, OVER_S = 1000.0, 1000.0, 0.5
PUNCTUATION = "。！？!?、，,……"
# Word classes that may open a piece, and words that may not stand at a cut.
CONTENT = ("名詞", "代名詞", "動詞", "形容詞", "形状詞", "副詞", "連体詞", "接続詞", "感動詞")
NOT_LEFT = ("の", "な", "お", "ご", "第", "約", "御")
NOT_RIGHT = ("そう", "よう", "みたい", "らしい", "べき", "はず", "わけ", "こと", "もの", "ところ", "つもり", "ない", "ん")
NOT_RIGHT_SURFACE = (
    "いただく", "いただき", "いただい", "くださる", "ください", "くださり", "くれる", "くれ", "もらう", "もらい", "しまう", "しまい", "おく", "おき", "あげる", "あげ", "やる", "やり", "なさい", "なさる",
)


def _cuts(words: Column) -> Column:
    n = F.size(words)
    return F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))


def boundary_ok(left: Column, right: Column) -> Column:
    """Whether a cut between two morphemes leaves no clinging word at either side."""
    lemma = lambda m: F.element_at(F.split(F.coalesce(m["lemma"], F.lit("")), "-"), 1)
    ok = right["pos1"].isin(*CONTENT) & ~right["surface"].isin(*NOT_RIGHT) & ~lemma(right).isin(*NOT_RIGHT) & ~right["surface"].isin(*NOT_RIGHT_SURFACE)
    ok = ok & ~left["pos1"].isin("接頭辞", "助動詞") & ~left["surface"].isin(*NOT_LEFT) & ~lemma(left).isin(*NOT_LEFT)
    ok = ok & ~((right["surface"] == left["surface"]) & (F.length(right["surface"]) >= 2))
    return F.coalesce(ok & ~(left["pos2"].isin("数詞", "助数詞") & (right["pos2"] == "助数詞")), F.lit(False))


def ends_clause(left: Column) -> Column:
    return F.coalesce((left["pos1"] == "助詞") & left["pos2"].isin("接続助詞", "終助詞"), F.lit(False))


def with_offsets(words: Column) -> Column:
    """Start of each word in the joined text."""
    return let(running(words, lambda w: F.length(w["word"])), lambda sums: F.slice(sums, F.lit(1), F.size(words)))


# --- the cuts of a cue -------------------------------------------------------------------------------


def _owners(morphemes: Column) -> Column:
    """Number of the morpheme that each letter of the text belongs to, -1 for none."""
    ends = lambda i: F.coalesce(F.get(morphemes, i - 1)["end"], F.lit(0))
    own = lambda m, i: F.concat(F.array_repeat(F.lit(-1), (m["start"] - ends(i)).cast("int")), F.array_repeat(i, (m["end"] - m["start"]).cast("int")))
    return F.flatten(F.transform(morphemes, own))


def cut_table(words: Column, morphemes: Column | None = None) -> Column:
    """Every place between words, as structs (k, c, rest, e, s, level, weak, long).

    c and rest count the letters before and after it, e and s are the times when the word before ends and
    the one after starts.  ``level`` is S after punctuation, P at a pause, C after a clause, null if the place
    is no legal cut; ``weak`` and ``long`` mark W and G.  Offsets are running sums, made once for a cue, and
    the morphemes at a place are looked up by the letters beside it, so the work grows with the text.
    Without morphemes only S and P.
    """
    letters = running(words, lambda w: F.length(compact(w["word"])))
    offsets = running(words, lambda w: F.length(F.coalesce(w["word"], F.lit(""))))
    none = F.lit(None)

    def place(k: Column, c: Column, total: Column, left: Column | None, right: Column | None) -> Column:
        before, after = F.get(words, k - 1), F.get(words, k)
        stop, opens = F.coalesce(F.rlike(before["word"], F.lit(f"[{PUNCTUATION}]$")), F.lit(False)), F.coalesce(F.rlike(after["word"], F.lit(f"^[{PUNCTUATION}]")), F.lit(False))
        gap = after["start"] - before["end"]
        level, weak, long = F.when(stop, F.when(~opens, "S")).when(gap >= SAFE_GAP, "P"), F.lit(False), F.lit(False)
        if left is not None:
            fine, clause = left.isNotNull() & right.isNotNull() & boundary_ok(left, right), ends_clause(left)
            tagged = F.when(right.isNull(), none).when(stop, F.when(~opens, "S")).when(fine & (gap >= SAFE_GAP), "P").when(fine & clause, "C")
            level = F.when(morphemes.isNull(), level).otherwise(tagged)
            weak = fine & ~stop & (gap < SAFE_GAP) & ~clause
            long = fine & (gap >= HARD_GAP) & ~stop & ~opens & (c >= LEAST_GAP_CHARS) & (total - c >= LEAST_GAP_CHARS)
        return F.struct(
            k.cast("int").alias("k"), c.alias("c"), (total - c).alias("rest"), before["end"].cast("long").alias("e"), after["start"].cast("long").alias("s"),
            level.alias("level"), F.coalesce(weak, F.lit(False)).alias("weak"), F.coalesce(long, F.lit(False)).alias("long"),
        )

    def plain(sums: Column) -> Column:
        return F.transform(_cuts(words), lambda k: place(k, F.get(sums, k), F.element_at(sums, -1), None, None))

    def tagged(sums: Column) -> Column:
        def at(k: Column, offset: Column, own: Column) -> Column:
            left, right = F.get(morphemes, F.get(own, offset - 1)), F.get(morphemes, F.get(own, offset))
            sides = F.struct(F.when(left["end"] == offset, left).alias("left"), F.when(right["start"] == offset, right).alias("right"))
            return let(sides, lambda x: place(k, F.get(sums, k), F.element_at(sums, -1), x["left"], x["right"]))

        known = F.struct(offsets.alias("offsets"), F.coalesce(_owners(morphemes), F.array().cast("array<int>")).alias("own"))
        return let(known, lambda x: F.transform(_cuts(words), lambda k: at(k, F.get(x["offsets"], k), x["own"])))

    return let(letters, plain if morphemes is None else tagged)


def _named(cuts: Column, keep, level) -> Column:
    return F.transform(F.filter(cuts, keep), lambda c: F.struct(c["k"].alias("k"), level(c).alias("level")))


def legal_of(cuts: Column) -> Column:
    """C4: structs (k, level) of a cut table: S, P and C."""
    return _named(cuts, lambda c: c["level"].isNotNull(), lambda c: c["level"])


def weak_of(cuts: Column) -> Column:
    """W, grammatical places that are neither punctuation, pause nor clause end."""
    return _named(cuts, lambda c: c["weak"], lambda c: F.lit("W"))


def gaps_of(cuts: Column) -> Column:
    """G, long silences between morphemes with three letters on either side."""
    return _named(cuts, lambda c: c["long"], lambda c: F.lit("G"))


def legal_cuts(words: Column, morphemes: Column | None = None) -> Column:
    """C4 of words with times, without the other columns of ``cut_table``."""
    return let(cut_table(words, morphemes), legal_of)


# --- path search over the cuts of one cue ------------------------------------------------------------


def _size_fits(size: Column, max_chars: int) -> Column:
    return (size >= LEAST_CHARS) & (size <= max_chars)


def best_path(places: Column, last: Column, start: Column, max_seconds: float, max_chars: int) -> Column:
    """The places (k, c, e, s) of the cheapest way through a cue, the last one included; null if there is none.

    A fold over the places.  Its state is the window of places reached so far that pieces of at most
    ``max_chars`` letters can start from, each with its cost and the way to it: 1000 a piece, and 1000 a
    second beyond the limit and its tolerance.  Of equal costs the earliest place wins.
    """
    way = "array<struct<k:int,c:int,e:bigint,s:bigint>>"
    state = f"array<struct<cost:double,k:int,c:int,s:bigint,way:{way}>>"
    zero = F.array(F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("k"), F.lit(0).alias("c"), start.cast("long").alias("s"), F.array().cast(way).alias("way"))).cast(state)

    def step(reached: Column, b: Column) -> Column:
        def priced(a: Column) -> Column:
            over = F.greatest(F.lit(0.0), (b["e"] - a["s"]) / 1000.0 - max_seconds - OVER_S)
            return F.struct((a["cost"] + over * OVER_COST + CUT_COST).alias("cost"), a["k"].alias("k"), a["way"].alias("way"))

        near = F.filter(reached, lambda a: b["c"] - a["c"] <= max_chars)
        best = F.array_min(F.transform(F.filter(reached, lambda a: _size_fits(b["c"] - a["c"], max_chars)), priced))
        made = lambda x: F.struct(x["cost"].alias("cost"), b["k"].alias("k"), b["c"].alias("c"), b["s"].alias("s"), F.array_append(x["way"], b).alias("way"))
        return let(best, lambda x: F.when(x.isNull(), near).otherwise(F.array_append(near, made(x)))).cast(state)

    ends = F.aggregate(F.array_append(places, last), zero, step)
    return F.get(F.filter(ends, lambda x: x["k"] == last["k"]), F.lit(0))["way"]


def path_errors(places: Column, wish: Column, allowed: Column, first: Column, last: Column, max_chars: int) -> Column:
    """Why proposed cuts cannot be used; empty if they can.  places: all of the cue's, allowed: numbers of legal ones."""
    ks = F.array_sort(F.array_distinct(wish))
    said = lambda what, *of: F.concat(F.lit(what), *[x if isinstance(x, Column) else F.lit(x) for x in of])

    def checked(ks: Column) -> Column:
        wrong = F.filter(ks, lambda k: ~((k > 0) & (k < last["k"])) | ~F.array_contains(allowed, k))
        wrong = F.transform(wrong, lambda k: said(F.when((k > 0) & (k < last["k"]), "illegal:").otherwise("out_of_range:"), k.cast("string")))
        bounds = F.concat(F.array(first), F.filter(places, lambda c: F.array_contains(ks, c["k"])), F.array(last))

        def sized(p: Column) -> Column:
            size, where = p["b"]["c"] - p["a"]["c"], lambda what: said(F.lit(what), p["a"]["k"].cast("string"), "-", p["b"]["k"].cast("string"))
            return F.when(size > max_chars, where("too_long:")).when(size < LEAST_CHARS, where("too_short:"))

        sizes = F.filter(F.transform(pairs_of(bounds), sized), lambda x: x.isNotNull())
        return F.when(F.size(ks) == 0, F.array(F.lit("empty"))).otherwise(let(wrong, lambda w: F.when(F.size(w) > 0, w).otherwise(sizes)))

    return F.when(wish.isNull(), F.array(F.lit("none_proposed"))).otherwise(let(ks, checked))


def without_redundant(path: Column, first: Column, last: Column, max_seconds: float, max_chars: int) -> Column:
    """The places of a path without those that the limits do not need, the earliest dropped first.

    A place can go if all pieces are then within the limits.  Once that holds, dropping a place only makes
    the pieces beside it longer, so one pass from the start decides the rest; before, only a place between
    the pieces that break a limit can go.
    """

    def fits(a: Column, b: Column) -> Column:
        return ((b["e"] - a["s"]) / 1000.0 <= max_seconds + 0.05) & _size_fits(b["c"] - a["c"], max_chars)

    def lean(path: Column) -> Column:
        state = "struct<at:struct<k:int,c:int,e:bigint,s:bigint>,kept:array<struct<k:int,c:int,e:bigint,s:bigint>>>"
        ahead = pairs_of(F.array_append(path, last))
        kept = lambda t, p: F.when(fits(t["at"], p["b"]), t).otherwise(F.struct(p["a"].alias("at"), F.array_append(t["kept"], p["a"]).alias("kept")).cast(state))
        return F.aggregate(ahead, F.struct(first.alias("at"), F.array().alias("kept")).cast(state), kept)["kept"]

    def mended(path: Column, bad: Column) -> Column:
        n = F.aggregate(bad, F.lit(0), lambda total, x: total + x)
        bounds = F.concat(F.array(first), path, F.array(last))
        free = lambda i: (n == F.get(bad, i) + F.get(bad, i + 1)) & fits(F.get(bounds, i), F.get(bounds, i + 2))
        at = F.get(F.filter(F.sequence(F.lit(0), F.size(path) - 1), free), F.lit(0))
        less = lambda i: F.when(i.isNull(), path).otherwise(lean(F.filter(path, lambda x, j: j != i)))
        return F.when(n == 0, lean(path)).otherwise(let(at, less))

    bad = F.transform(pairs_of(F.concat(F.array(first), path, F.array(last))), lambda p: F.when(fits(p["a"], p["b"]), 0).otherwise(1))
    return F.when(F.size(path) == 0, path).otherwise(let(bad, lambda b: mended(path, b)))


def plan_of(words: Column, cuts: Column, weaker: bool, proposed: Column | None, max_seconds: float, max_chars: int) -> Column:
    """Struct (cuts, how, errors): proposed cuts if valid, else the best path, else none; redundant ones go.

    Weaker levels (W, then G) join only where the letters exceed the limit and nothing else fits.
    """
    node = lambda k, c, e, s: F.struct(k.cast("int").alias("k"), c.cast("int").alias("c"), e.cast("long").alias("e"), s.cast("long").alias("s"))
    bare = lambda c: node(c["k"], c["c"], c["e"], c["s"])
    total = F.aggregate(words, F.lit(0), lambda n, w: n + F.length(compact(w["word"])))
    start, none = F.get(words, F.lit(0))["start"], F.lit(None).cast("long")
    ends = F.struct(node(F.lit(0), F.lit(0), none, start).alias("first"), node(F.size(words), total, F.element_at(words, -1)["end"], none).alias("last"))

    def with_ends(first: Column, last: Column) -> Column:
        def level(keep) -> tuple[Column, Column]:
            places = F.transform(F.filter(cuts, keep), bare)
            return F.transform(places, lambda c: c["k"]), best_path(places, last, start, max_seconds, max_chars)

        def ladder(steps: list) -> Column:
            allowed, path = level(steps[0])
            here = F.struct(allowed.alias("allowed"), path.alias("path"))
            if len(steps) == 1:
                return here
            return let(here, lambda x: F.when((last["c"] <= max_chars) | x["path"].isNotNull(), x).otherwise(ladder(steps[1:])))

        steps = [lambda c: c["level"].isNotNull()]
        if weaker:
            steps += [lambda c: c["level"].isNotNull() | c["weak"], lambda c: c["level"].isNotNull() | c["weak"] | c["long"]]

        def decided(found: Column, errors: Column) -> Column:
            searched = F.coalesce(F.slice(found["path"], F.lit(1), F.size(found["path"]) - 1), F.array().cast("array<struct<k:int,c:int,e:bigint,s:bigint>>"))
            path, how = searched, F.when(F.size(searched) > 0, "searched").when(last["c"] > max_chars, "rejected").otherwise("kept")
            if proposed is not None:
                path = F.when(F.size(errors) == 0, F.transform(F.filter(cuts, lambda c: F.array_contains(proposed, c["k"])), bare)).otherwise(searched)
                how = F.when(F.size(errors) == 0, "proposed").otherwise(how)
            lean = let(path, lambda p: without_redundant(p, first, last, max_seconds, max_chars))
            return F.struct(F.transform(lean, lambda c: c["k"]).alias("cuts"), how.alias("how"), errors.alias("errors"))

        def judged(found: Column) -> Column:
            if proposed is None:
                return decided(found, F.array(F.lit("none_proposed")))
            return let(path_errors(F.transform(cuts, bare), proposed, found["allowed"], first, last, max_chars), lambda errors: decided(found, errors))

        return let(ladder(steps), judged)

    return let(ends, lambda x: with_ends(x["first"], x["last"]))


def over_long(cue_tokens: DataFrame, max_seconds: float = 8.0, max_chars: int = 40) -> DataFrame:
    """The cues that are to be cut, if their words spell their text."""
    spelled = F.array_join(F.transform("words", lambda w: w["word"]), "")
    return cue_tokens.filter((F.size("words") > 0) & is_too_long(spelled, F.col("words"), max_seconds, max_chars)).filter(compact(spelled) == compact("text"))


def cut_requests(cue_tokens: DataFrame, max_seconds: float = 8.0, max_chars: int = 40) -> DataFrame:
    """M5: what a model is asked for each over-long cue: rows (file, seq, text, chars, ms, choices, prompt).

    choices are the legal cuts: label (A, B, ...), k, level, letters and time up to the cut, and its preview.
    ``prompt`` is the same as JSON, with the limits; its wording is left to the caller.
    """
    long = over_long(cue_tokens, max_seconds, max_chars)
    morphemes, words = F.col("morphemes") if "morphemes" in long.columns else None, F.col("words")
    long = long.repartition("file", "seq").withColumns({"cuts": cut_table(words, morphemes), "begin": F.get(words, F.lit(0))["start"].cast("long")})
    shown = lambda c, i: F.struct(
        sheet_label(i).alias("label"), c["k"].alias("k"), c["level"].alias("level"), c["c"].alias("chars"), (c["e"] - F.col("begin")).alias("ms"), cut_preview(words, c["k"]).alias("preview"),
    )
    choices = F.transform(F.filter("cuts", lambda c: c["level"].isNotNull()), shown)
    rows = long.select("file", "seq", "text", F.length(compact("text")).alias("chars"), (F.element_at(words, -1)["end"].cast("long") - F.col("begin")).alias("ms"), choices.alias("choices"))
    return rows.withColumn("prompt", F.to_json(F.struct("text", "chars", "ms", F.lit(max_chars).alias("max_chars"), F.lit(max_seconds).alias("max_seconds"), "choices")))


def plan_in_rounds(cue_tokens: DataFrame, askers: list[Callable[[DataFrame], DataFrame]], max_seconds: float = 8.0, max_chars: int = 40) -> tuple[DataFrame, DataFrame]:
    """C14: plans as of ``plan_cuts``, and per file what became of its cues, after rounds of proposals.

    An asker takes cue tokens and returns rows (file, seq, proposed) for those it has an answer to; the others
    are asked for again in the next round, until none is left or no asker.  An answer that cannot be used is
    no reason to ask again: such cues, and those without an answer, are searched.  Answers are written before
    they are read again, so nothing is asked twice.  Figures: (file, long, asked, unanswered, proposed,
    searched, rejected, kept), asked being the requests of all rounds.
    """
    long = checkpointed(over_long(cue_tokens, max_seconds, max_chars))
    rest, answers, asked = long, None, None
    for ask in askers:
        requests = rest.groupBy("file").agg(F.count("*").alias("asked"))
        asked = requests if asked is None else asked.unionByName(requests)
        got = checkpointed(ask(rest).select("file", "seq", "proposed"))
        answers = got if answers is None else answers.unionByName(got)
        rest = checkpointed(rest.join(got.select("file", "seq"), ["file", "seq"], "left_anti"))
        if rest.isEmpty():
            break
    tokens = long if answers is None else long.drop("proposed").join(answers, ["file", "seq"], "left")
    plans = checkpointed(plan_cuts(tokens, max_seconds, max_chars))
    counts = [F.count_if(F.col("plan.how") == how).alias(how) for how in ("proposed", "searched", "rejected", "kept")]
    figures = plans.groupBy("file").agg(F.count("*").alias("long"), *counts)
    left = rest.groupBy("file").agg(F.count("*").alias("unanswered"))
    total = plans.select("file").limit(0).withColumn("asked", F.lit(0).cast("long")) if asked is None else asked.groupBy("file").agg(F.sum("asked").alias("asked"))
    figures = figures.join(total, "file", "left").join(left, "file", "left").na.fill(0, ["asked", "unanswered"])
    return plans, figures.select("file", "long", "asked", "unanswered", "proposed", "searched", "rejected", "kept")


def plan_cuts(cue_tokens: DataFrame, max_seconds: float = 8.0, max_chars: int = 40) -> DataFrame:
    """C13 + C11: plans for the over-long cues: rows (file, seq, words, legal, plan)."""
    long = over_long(cue_tokens, max_seconds, max_chars)
    morphemes = F.col("morphemes") if "morphemes" in long.columns else None
    proposed = F.col("proposed") if "proposed" in long.columns else None
    # A file's cues are searched by many tasks, however the files are stored.
    long = long.repartition("file", "seq").withColumn("cuts", cut_table(F.col("words"), morphemes))
    plan = plan_of(F.col("words"), F.col("cuts"), morphemes is not None, proposed, max_seconds, max_chars)
    return long.select("file", "seq", "words", legal_of(F.col("cuts")).alias("legal"), plan.alias("plan"))


def pieces_of(plans: DataFrame) -> DataFrame:
    """rows (file, seq, piece, time_ms, end_ms, text) of cues with cuts."""
    cuts = F.array_sort(F.array_distinct(F.col("plan.cuts")))
    bounds = F.concat(F.array(F.lit(0)), cuts, F.array(F.size("words")))
    ranges = F.zip_with(F.slice(bounds, F.lit(1), F.size(bounds) - 1), F.slice(bounds, F.lit(2), F.size(bounds) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    # A filter on the plan, or the one that Spark infers for an inner explode, would work the plan out twice.
    some = F.when(F.size("plan.cuts") > 0, ranges)
    each = plans.select("file", "seq", "words", F.posexplode_outer(some).alias("piece", "r")).filter("r is not null")
    part = F.slice("words", F.col("r.a") + 1, F.col("r.b") - F.col("r.a"))
    return each.select("file", "seq", "piece", F.element_at(part, 1)["start"].alias("time_ms"), F.element_at(part, -1)["end"].alias("end_ms"), F.array_join(F.transform(part, lambda w: w["word"]), "").alias("text")).filter("text <> ''")


def apply_cuts(items: DataFrame, pieces: DataFrame) -> DataFrame:
    """items(file, line_no, item_type, time_ms, text, raw) with split lyrics replaced by their pieces.

    A clear item follows a piece if 800 ms or more pass before what comes next (W5); adjacent equal
    clears collapse (W4).  Files whose text would change are left as they were (column ``lossless``).
    """
    by = Window.partitionBy("file").orderBy("line_no")
    lyric = (F.col("item_type") == "lyric").cast("int")
    timed = F.when(F.col("item_type").isin("lyric", "clear"), F.col("time_ms"))
    base = items.withColumns({"seq": F.when(F.col("item_type") == "lyric", F.sum(lyric).over(by) - 1), "after": F.first(timed, ignorenulls=True).over(by.rowsBetween(1, Window.unboundedFollowing))})
    many = pieces.withColumn("n", F.count("*").over(Window.partitionBy("file", "seq"))).filter("n > 1").drop("n")
    by_piece = Window.partitionBy("file", "seq").orderBy("piece")
    many = many.withColumn("next_ms", F.lead("time_ms").over(by_piece)).withColumnsRenamed({"time_ms": "piece_ms", "text": "piece_text"})
    joined = base.join(many, ["file", "seq"], "left")
    follow = F.coalesce("next_ms", "after")
    clear = F.col("piece").isNotNull() & (follow.isNull() | (follow - F.col("end_ms") >= CLEAR_GAP))
    own = F.struct(
        F.col("item_type"), F.coalesce("piece_ms", "time_ms").alias("time_ms"), F.coalesce("piece_text", "text").alias("text"), F.col("raw"),
    )
    wiped = F.struct(F.lit("clear").alias("item_type"), F.col("end_ms").alias("time_ms"), F.lit("").alias("text"), F.lit(None).cast("string").alias("raw"))
    rows = joined.select("file", "line_no", F.coalesce("piece", F.lit(0)).alias("piece"), F.posexplode(F.when(clear, F.array(own, wiped)).otherwise(F.array(own))).alias("half", "item"))
    rows = rows.select("file", "line_no", "piece", "half", "item.*")
    order = Window.partitionBy("file").orderBy("line_no", "piece", "half")
    twin = (F.col("item_type") == "clear") & (F.lag("item_type").over(order) == "clear") & (F.lag("time_ms").over(order) == F.col("time_ms"))
    rows = rows.withColumn("twin", F.coalesce(twin, F.lit(False))).filter("not twin").withColumn("line_no_new", F.row_number().over(order) - 1)

    def spoken(df: DataFrame, *keys: str) -> DataFrame:
        ordered = F.array_sort(F.collect_list(F.struct(*keys, compact("text").alias("t"))))
        return df.filter("item_type = 'lyric'").groupBy("file").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), "").alias("spoken"))

    same = spoken(items, "line_no").join(spoken(rows, "line_no_new").withColumnRenamed("spoken", "rebuilt"), "file").select("file", (F.col("spoken") == F.col("rebuilt")).alias("lossless"))
    return rows.join(same, "file", "left").select("file", F.col("line_no_new").alias("line_no"), "item_type", "time_ms", "text", "raw", F.coalesce("lossless", F.lit(True)).alias("lossless"))


def cut_preview(words: Column, k: Column, width: int = 16) -> Column:
    """up to ``width`` characters on either side of a cut."""
    text = lambda part: F.array_join(F.transform(part, lambda w: w["word"]), "")
    return F.concat(F.right(text(F.slice(words, F.lit(1), k)), F.lit(width)), F.lit("|"), F.left(text(F.slice(words, k + 1, F.size(words))), F.lit(width)))


def stats_by_file(items: DataFrame, plans: DataFrame, pieces: DataFrame) -> DataFrame:
    """C14: per file the lyrics, over-long cues and pieces."""
    lyrics = items.filter("item_type = 'lyric'").groupBy("file").agg(F.count("*").alias("segments"))
    long = plans.groupBy("file").agg(F.count("*").alias("long"))
    split = pieces.groupBy("file").agg(F.count("*").alias("split"))
    return lyrics.join(long, "file", "left").join(split, "file", "left").na.fill(0, ["long", "split"])
