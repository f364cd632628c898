"""Operators that build segments from other segments: speech merging, scene merging and splitting."""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mediatimeline.functions.render import cosine
from mediatimeline.operators.joins import nearest
from mediatimeline.operators.ordered import NO_CUTS, Cuts, Track, attach, islands
from mediatimeline.session import settle, ship

# Words that may open a new sentence after an unfinished one (fixed values).
OPENERS = ("And", "But", "So", "Now", "Then", "However")
SHORT_SECONDS, SMALL_GAP, PAUSE_GAP, FEW_WORDS, TINY_WORDS = 2.5, 0.8, 0.3, 4, 3


BLANK = r"[\x09-\x0D\x1C-\x20\x85\p{Z}]"  # white space of any script
LOOK_AHEAD = 4  # behind so many possible cuts a segment is long enough and has words enough


def _stripped(text: Column) -> Column:
    return F.regexp_replace(text, rf"^{BLANK}+|{BLANK}+\z", "")


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, rf"{BLANK}+", " "))


def _cut_successors(nodes: DataFrame, key: str, found: Cuts) -> tuple[DataFrame, DataFrame]:
    """(key, node, to) of every possible cut, the cut that ends the segment behind it, and the cuts that are made anyway.

    Node 0 is the first row. At a node the segment to come has a start, a word count before it and its own pause count;
    a later cut ends it if it lasts, has words enough, and its text is complete. Length and words are sure to suffice
    behind LOOK_AHEAD cuts, since gaps and words of the rows behind cuts add up; from there the next complete one counts.
    """
    full = Track(nodes, (key,), ("start", "ordinal"), found).last_known(backward=True, full=F.when(F.col("complete"), F.col("node"))).df
    offers = full.select(key, F.col("node").alias("to"), "end", "words", "pauses", "complete", "full",
                         F.explode(F.array(*[F.lit(k) for k in range(1, LOOK_AHEAD + 2)])).alias("step"))
    offers = offers.select("*", (F.col("to") - F.col("step")).alias("node")).where("node >= 0")
    own = nodes.select(key, "node", "from_start", "words_before", "own_pauses", "from_pauses")
    met = offers.join(own, [key, "node"])
    # A pause before the first text of a segment is a word of its own.
    mark = F.when(F.least(F.coalesce("from_pauses", "pauses"), "pauses") > F.col("own_pauses"), 1).otherwise(0)
    ends = (F.col("complete") & (F.col("end") - F.col("from_start") >= SHORT_SECONDS)
            & (F.col("words") - F.col("words_before") + mark >= FEW_WORDS))
    near = F.min(F.when(ends & (F.col("step") <= LOOK_AHEAD), F.col("to")))
    far = F.max(F.when(F.col("step") == LOOK_AHEAD + 1, F.col("full")))
    succ = settle(met.groupBy(key, "node").agg(F.coalesce(near, far).alias("to")))
    # What ends the shortest segment before it ends every segment that reaches it.
    return succ, succ.where("to = node + 1").select(key, F.col("to").alias("node"))


def _taken(succ: DataFrame, certain: DataFrame, key: str) -> DataFrame:
    """Cuts on the chains from the first row and from every certain cut, by doubling the steps."""
    reached = settle(certain.union(succ.where("node = 0").select(key, "node")))
    jumps = settle(succ.where("to is not null"))
    while True:
        ahead = reached.join(jumps, [key, "node"]).select(key, F.col("to").alias("node")).distinct()
        fresh = settle(ahead.join(reached, [key, "node"], "left_anti"))
        if fresh.isEmpty():
            return reached
        reached = reached.union(fresh)
        on = jumps.select(key, F.col("node").alias("to"), F.col("to").alias("then"))
        jumps = settle(jumps.join(on, [key, "to"]).select(key, "node", F.col("then").alias("to")))


def merge_segments(segments: DataFrame, key: str = "media_id", cuts: Cuts = NO_CUTS, first: tuple[str, ...] = (),
                   lists: tuple[str, ...] = ()) -> DataFrame:
    """Join speech segments that belong together, left to right.

    Segments: (key, ordinal, start, end, text, confidence), no end before its start, starts in order. A segment is cut off where
    it lasts SHORT_SECONDS, has FEW_WORDS, its text is complete or the next one opens a sentence, SMALL_GAP lies behind it,
    and the next has TINY_WORDS; else the next one joins it. Where a cut may lie, and whether the text is complete there,
    doesn't depend on where the segment began; so every possible cut knows which one follows it, and the cuts made are the
    chain from the first row. Rows of any number are handled by scans and joins; only the rows of one result meet in a row.

    Of the columns `first` the first segment's value stays; the arrays `lists` are joined if the first one isn't empty.
    """
    text = _stripped(F.col("text"))
    rows = segments.select(
        key, "ordinal", F.col("start").cast("double"), F.col("end").cast("double"), text.alias("text"),
        F.col("confidence").cast("double"), *first, *lists,
        F.when(text == "", 0).otherwise(F.size(F.split(_flat(text), " "))).cast("bigint").alias("n_words"),
        text.rlike(r"[.!?:]\z").alias("ends"), text.rlike("^(" + "|".join(OPENERS) + ")").alias("opens"))
    narrow = rows.select(key, "ordinal", "start", "end", "n_words", "ends", "opens", (F.col("text") != "").alias("said"))

    def written(track: Track) -> Track:
        """Scans over hot media join the rows with summaries of themselves; written in between, the plan stays short."""
        return Track(settle(track.df), (key,), ("start", "ordinal"), cuts) if cuts.hot else track

    track = Track(narrow, (key,), ("start", "ordinal"), cuts).previous(prev_end=F.col("end"))
    track = track.with_columns(pause=F.coalesce(F.col("start") - F.col("prev_end") >= PAUSE_GAP, F.lit(False)))
    track = written(track.following(next_start=F.col("start"), next_words=F.col("n_words"), next_opens=F.col("opens")))
    possible = (F.col("next_start") - F.col("end") >= SMALL_GAP) & (F.col("next_words") >= TINY_WORDS)
    track = track.with_columns(possible=F.coalesce(possible, F.lit(False)))
    track = written(track.running(words=F.col("n_words"), pauses=F.when(F.col("pause"), 1).otherwise(0).cast("bigint"),
                                  node=F.when(F.col("possible"), 1).otherwise(0).cast("bigint")))
    track = track.last_known(complete_text=F.when(F.col("said") | F.col("pause"), ~F.col("said") | F.col("ends")))
    track = written(track.last_known(backward=True, first_text=F.when(F.col("said"), F.col("pauses"))))
    track = track.following(after_pauses=F.col("pauses"), after_first=F.col("first_text"))
    where = track.df.where("possible").select(
        key, "ordinal", "start", "end", "node", "words", "pauses", "first_text",
        (F.col("next_opens") | F.coalesce("complete_text", F.lit(True))).alias("complete"), F.col("next_start").alias("from_start"),
        F.col("words").alias("words_before"), F.col("after_pauses").alias("own_pauses"), F.col("after_first").alias("from_pauses"))
    head = track.df.where(F.col("prev_end").isNull())
    zero = head.select(
        key, (F.col("ordinal") - 1).alias("ordinal"), (F.col("start") - 1).alias("start"), (F.col("start") - 1).alias("end"),
        F.lit(0).cast("bigint").alias("node"), F.lit(0).cast("bigint").alias("words"), F.lit(0).cast("bigint").alias("pauses"), "first_text",
        F.lit(False).alias("complete"), F.col("start").alias("from_start"), F.lit(0).cast("bigint").alias("words_before"),
        F.col("pauses").alias("own_pauses"), F.col("first_text").alias("from_pauses"))
    nodes = settle(zero.unionByName(where))
    made = _taken(*_cut_successors(nodes, key, cuts), key).where("node > 0")
    cut_rows = nodes.join(made, [key, "node"]).select(key, "ordinal", F.lit(True).alias("cut"))
    marked = Track(track.df.select(key, "ordinal", "start", "pause").join(cut_rows, [key, "ordinal"], "left"), (key,), ("start", "ordinal"), cuts)
    numbered = islands(marked.previous(was_cut=F.col("cut")), F.coalesce("was_cut", F.lit(False)), "island").df
    runs = rows.join(numbered.select(key, "ordinal", "pause", "island"), [key, "ordinal"])
    item = F.struct("start", "ordinal", "end", "text", "confidence", "pause", *first, *lists)
    parts = runs.groupBy(key, "island").agg(F.sort_array(F.collect_list(item)).alias("p"))
    begin, rest = F.col("p")[0], F.slice("p", 2, F.size("p"))
    said = F.transform(rest, lambda x: F.concat(F.when(x["pause"], "...").otherwise(""), F.when(x["text"] != "", F.concat(F.lit(" "), x["text"])).otherwise("")))

    def average(acc: Column, x: Column) -> Column:
        weight, extra = acc["end"] - begin["start"], x["end"] - x["start"]
        mixed = (acc["confidence"] * weight + x["confidence"] * extra) / (weight + extra)
        return F.struct(x["end"].alias("end"), F.when(weight + extra > 0, mixed).otherwise(acc["confidence"]).alias("confidence"))

    last = F.aggregate(rest, F.struct(begin["end"].alias("end"), begin["confidence"].alias("confidence")), average)
    joined = [F.when(F.size(begin[c]) > 0, F.flatten(F.filter(F.col("p")[c], lambda a: a.isNotNull()))).otherwise(begin[c]).alias(c)
              for c in lists]
    return parts.select(key, begin["start"].alias("start"), last.alias("last"), _flat(F.concat(begin["text"], F.array_join(said, ""))).alias("text"),
                        F.size("p").cast("bigint").alias("parts"), *[begin[c].alias(c) for c in first], *joined).select(
        key, "start", F.col("last")["end"].alias("end"), (F.col("last")["end"] - F.col("start")).alias("duration"), "text",
        F.col("last")["confidence"].alias("confidence"), "parts", *first, *lists)


def scene_vectors(scenes: DataFrame, vectors: DataFrame, key: str = "media_id", cuts: Cuts = NO_CUTS) -> DataFrame:
    """Scenes with the embedding nearest to their middle. `vectors`: (key, t, ordinal, embedding)."""
    middle = scenes.withColumns({"t": (F.col("start") + F.col("end")) / 2, "ordinal": F.col("scene_id")})
    found = nearest(middle, vectors, key, cuts, payload={"embedding": F.col("embedding")})
    return found.drop("t", "ordinal", "nearest_t", "distance")


def merge_round(scenes: DataFrame, vectors: DataFrame, threshold: float = 0.75, key: str = "media_id",
                cuts: Cuts = NO_CUTS) -> DataFrame:
    """One greedy pass: from left to right, join each scene with the next if they are alike.

    In a run of alike neighbours the 1st, 3rd, 5th ... join with their successor, so a run
    position replaces the pass. Adds `merged` and numbers the scenes anew.
    """
    track = Track(scene_vectors(scenes, vectors, key, cuts), (key,), ("start", "scene_id"), cuts)
    track = track.following(_next=F.col("embedding")).number("_n")
    alike = F.coalesce(cosine("embedding", "_next") > threshold, F.lit(False))
    track = track.with_columns(_alike=alike)
    track = track.last_known(_stop=F.when(~F.col("_alike"), F.col("_n")))
    joins = F.col("_alike") & ((F.col("_n") - F.coalesce("_stop", F.lit(0))) % 2 == 1)
    track = track.with_columns(_joins=joins).previous(_taken=F.col("_joins"))
    taken = F.coalesce(F.col("_taken"), F.lit(False))
    rows = track.df.withColumn("_group", F.col("_n") - taken.cast("int")).withColumn("_pair", F.col("_joins") | taken)
    at = F.col("_n")
    out = rows.groupBy(key, "_group").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.min("confidence").alias("confidence"),
        F.when(F.max("_pair"), F.lit("merged")).otherwise(F.min_by("semantic_type", at)).alias("semantic_type"),
        (F.sum("merge_count") + F.max(F.col("_pair").cast("int"))).cast("int").alias("merge_count"),
        F.max("split_count").alias("split_count"), F.max("_pair").alias("merged"))
    return out.withColumnRenamed("_group", "scene_id")


def merge_similar(scenes: DataFrame, vectors: DataFrame, threshold: float = 0.75, rounds: int = 5,
                  key: str = "media_id", cuts: Cuts = NO_CUTS) -> DataFrame:
    """Repeat `merge_round` until nothing joins, at most `rounds` times, for each media on its own.

    Only media that changed in a round go into the next, with their vectors; the others are done, and their
    `stability_iterations` is the round in which nothing joined (or `rounds`). What else is in the call never changes a
    media's rows. Each round is written once, so no plan contains the earlier ones and a lost executor redoes one round.
    """
    done: list[DataFrame] = []
    active, seen = scenes, vectors
    for iteration in range(1, rounds + 1):
        step = settle(merge_round(active, seen, threshold, key, cuts)).withColumn("stability_iterations", F.lit(iteration))
        changed = step.filter("merged").select(key).distinct()
        if iteration == rounds or changed.isEmpty():
            done.append(step.drop("merged"))
            break
        done.append(step.join(changed, key, "left_anti").drop("merged"))
        active = step.join(changed, key, "left_semi").drop("merged", "stability_iterations")
        seen = seen.join(changed, key, "left_semi")
    out = done[0] if done else scenes.withColumn("stability_iterations", F.lit(0))
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def split_dissimilar(scenes: DataFrame, vectors: DataFrame, threshold: float = 0.25, shortest: float = 2.0,
                     rapid: float = 1.0, key: str = "media_id", cuts: Cuts = NO_CUTS) -> DataFrame:
    """Split long scenes where consecutive samples inside them differ.

    At most four samples, every max(1, duration/5) seconds strictly inside the scene. A split falls
    on the later sample if both edges of the scene are at least `shortest` away.
    """
    start, end = F.col("start"), F.col("end")
    every = F.greatest(F.lit(1.0), (end - start) / 5)
    long_enough = scenes.filter(end - start >= shortest * 2)
    times, at = [], start
    for _ in range(4):
        at = at + every
        times.append(at)
    inside = F.filter(F.array(*times), lambda t: t < end - every)
    samples = long_enough.select(key, "scene_id", "start", "end", F.posexplode(inside).alias("_k", "t"))
    samples = samples.withColumn("ordinal", F.col("scene_id") * 4 + F.col("_k"))
    seen = nearest(samples, vectors, key, cuts, payload={"embedding": F.col("embedding")})
    in_scene = Window.partitionBy(key, "scene_id").orderBy("_k")  # at most four rows
    unlike = cosine(F.lag("embedding").over(in_scene), F.col("embedding")) < threshold
    points = seen.withColumn("_unlike", unlike).filter(
        F.col("_unlike") & (F.col("t") - start >= shortest) & (end - F.col("t") >= shortest))
    splits = points.groupBy(key, "scene_id").agg(F.array_sort(F.collect_list("t")).alias("_splits"))
    joined = scenes.join(splits, [key, "scene_id"], "left")
    edges = F.concat(F.array(start), F.coalesce("_splits", F.array().cast("array<double>")), F.array(end))
    pieces = F.transform(F.sequence(F.lit(1), F.size(edges) - 1), lambda i: F.struct(
        (i - 1).alias("piece"), F.get(edges, i - 1).alias("start"), F.get(edges, i).alias("end")))
    cut = F.col("_splits").isNotNull()
    out = joined.withColumns({"_p": F.explode(pieces), "_cut": cut}).withColumns({
        "piece": F.col("_p.piece"), "start": F.col("_p.start"), "end": F.col("_p.end"),
        "semantic_type": F.when(cut, "split").otherwise(F.col("semantic_type")),
        "split_count": F.col("split_count") + cut.cast("int"),
    })
    out = out.drop("_p", "_splits")
    marked = mark_rapid(out.filter("_cut"), rapid).unionByName(out.filter("not _cut"))
    return marked.drop("_cut")


def mark_rapid(scenes: DataFrame, shortest: float = 1.0) -> DataFrame:
    """Scenes under `shortest` seconds become rapid cuts, whatever they were."""
    kind = F.when(F.col("end") - F.col("start") < shortest, "rapid_cut").otherwise(F.col("semantic_type"))
    return scenes.withColumn("semantic_type", kind)


def _ward_boundaries(points: np.ndarray, weights: np.ndarray, k: int) -> list[int]:
    """Left edges after joining neighbouring groups of least added variance until k remain."""
    means, sizes = [np.asarray(p, dtype=float) for p in points], [float(w) for w in weights]
    after, before = list(range(1, len(means) + 1)), list(range(-1, len(means) - 1))
    alive, stamp = [True] * len(means), [0] * len(means)

    def offer(i: int) -> None:
        j = after[i]
        if i >= 0 and j < len(means):
            cost = sizes[i] * sizes[j] / (sizes[i] + sizes[j]) * float(((means[i] - means[j]) ** 2).sum())
            heapq.heappush(queue, (cost, i, j, stamp[i], stamp[j]))

    queue: list[tuple] = []
    for i in range(len(means)):
        offer(i)
    for _ in range(len(means) - k):
        while True:  # offers of sections that have changed since are out of date
            _, i, j, old_i, old_j = heapq.heappop(queue)
            if alive[i] and alive[j] and (stamp[i], stamp[j]) == (old_i, old_j):
                break
        total = sizes[i] + sizes[j]
        means[i] = (means[i] * sizes[i] + means[j] * sizes[j]) / total
        sizes[i], alive[j], after[i] = total, False, after[j]
        stamp[i] += 1
        if after[i] < len(means):
            before[after[i]] = i
        offer(i)
        if before[i] >= 0:
            offer(before[i])
    return [i for i in range(len(means)) if alive[i]]


def structural_segments(frames: DataFrame, durations: DataFrame, k: int = 5, seconds: float = 1.0, vector: str = "embedding",
                        close_tail: bool = True, key: str = "media_id", cuts: Cuts = NO_CUTS) -> DataFrame:
    """Cut each media into k sections of similar frames.

    Frames are first averaged into slots of `seconds` (map-side), the same for media of every length; then neighbours are
    merged at the lowest cost until k are left, in n log n steps for n slots of one media, which meet in one task. Media with
    fewer than k slots get equal parts. `close_tail` adds the last section, which ends with the media.
    """
    slot = F.floor(F.col("t") / seconds).cast("bigint")
    placed = attach(frames, durations.select(key, "duration"), key, cuts=cuts, how="inner").withColumn("_slot", slot)
    items = placed.select(key, "duration", "_slot", "t", F.posexplode(vector).alias("_d", "_v"))
    means = items.groupBy(key, "_slot", "_d").agg(
        F.avg(F.col("_v").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"), F.min("t").alias("t"),
        F.max("duration").alias("duration"))
    slots = means.groupBy(key, "_slot").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("_d", "v"))), lambda i: i["v"]).alias("v"),
        F.max("n").alias("n"), F.min("t").alias("t"), F.max("duration").alias("duration"))
    kind = durations.schema[key].dataType.simpleString()

    def sections(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_slot").reset_index(drop=True)
        duration = float(pdf["duration"].iloc[0])
        if len(pdf) < k:
            parts = max(3, int(duration / 30.0))
            edges = [duration * i / parts for i in range(parts + 1)]
        else:
            lefts = _ward_boundaries(np.vstack(pdf["v"].to_numpy()), pdf["n"].to_numpy(dtype=float), k)
            edges = [float(pdf["t"].iloc[i]) for i in lefts] + ([duration] if close_tail else [])
        return pd.DataFrame({key: pdf[key].iloc[0], "segment": range(len(edges) - 1), "start": edges[:-1],
                             "end": edges[1:], "total_segments": len(edges) - 1})

    ship(slots.sparkSession)
    return slots.groupBy(key).applyInPandas(
        sections, f"{key} {kind}, segment bigint, start double, end double, total_segments bigint")
