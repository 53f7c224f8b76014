"""Pipelines over curriculum frames: merging chunks, fixing, enriching, validating, nesting.

A step works on all books at once; what is numbered or ordered is so inside a
book. ``doc_pos`` is the last tie-break everywhere.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chalkline.functions.classify import ACTIVITY_ORDER, EXERCISES, SKILLS, STANDARD, is_garbage, rules, with_activity, with_concepts, without_meta
from chalkline.functions.numeric import round_half_up
from chalkline.functions.text import first_keyword, norm_name, normalised, semantic_name, stripped
from chalkline.operators.folds import first_by
from chalkline.operators.graph import break_cycles
from chalkline.operators.arrays import resolve_arrays
from chalkline.operators.lineage import Scratch
from chalkline.operators.structure import clamp_range, fold_dedup, islands, numbered, pages_of
from chalkline.sources.documents import Curriculum

#: Pages that an orphan's chapter may be away.
REACH = 19
#: Bits of a place in a chunk, over which the chunk's number stands.
CHUNK = 52
#: Exercises that a task puts together when lists of them are made.
SHARE = 1 << 17


def merge_chunks(chunks: list[Curriculum]) -> Curriculum:
    """Chunks of books, in order, as one: the first entity of an id stays, and of topics the first of a name in its chapter.

    A topic that its name turns away doesn't take its id; its exercises and
    edges still come along. Edges of a graph are one by (child, parent, kind).
    """

    def union(part: str) -> DataFrame:
        whole = None
        for i, chunk in enumerate(chunks):
            one = getattr(chunk, part).withColumn("doc_pos", F.col("doc_pos").cast("long") + (i << CHUNK))
            whole = one if whole is None else whole.unionByName(one, allowMissingColumns=True)
        return whole

    def by_id(df: DataFrame) -> DataFrame:
        known = df.where(F.coalesce("id", F.lit("")) != "")
        return known.withColumn("_n", F.row_number().over(W.partitionBy("book", "id").orderBy("doc_pos"))).where("_n = 1").drop("_n")

    topics = union("topics").where(F.coalesce("id", F.lit("")) != "")
    keyed = topics.withColumn("_name", F.concat_ws("|", F.coalesce("chapter_id", F.lit("")), F.lower(F.trim(F.coalesce("name", F.lit(""))))))
    kept = fold_dedup(keyed, ["book"], ["doc_pos"], "id", "_name", "doc_pos", carry=["book"])
    edges = first_by(union("edges"), ["book", "graph", "child", "parent", "kind"], [F.col("doc_pos")])
    parts = {part: by_id(union(part)) for part in ("chapters", "subtopics", "exercises", "sidebars")}
    return Curriculum(topics=topics.join(kept, ["book", "doc_pos"], "left_semi"), edges=edges, **parts)


def concatenated(chunks: list[Curriculum]) -> Curriculum:
    """Chunks one after another, nothing left out."""
    whole = {}
    for part in ("chapters", "topics", "subtopics", "exercises", "sidebars", "edges"):
        for i, chunk in enumerate(chunks):
            one = getattr(chunk, part).withColumn("doc_pos", F.col("doc_pos").cast("long") + (i << CHUNK))
            whole[part] = one if i == 0 else whole[part].unionByName(one, allowMissingColumns=True)
    return Curriculum(**whole)


def with_new_edges(old: DataFrame, new: DataFrame, graph: str = "concept_dependencies") -> DataFrame:
    """Edges ``old``, and those of ``new`` (book, doc_pos, child, parent, kind) whose ends aren't linked yet, whatever the kind; no self loops."""
    linked = old.where(F.col("graph") == graph).select("book", "child", "parent").distinct()
    fresh = first_by(new.where("child <> parent").join(linked, ["book", "child", "parent"], "left_anti"), ["book", "child", "parent"], [F.col("doc_pos")])
    return old.unionByName(fresh.withColumn("graph", F.lit(graph)).select(*old.columns))


def nearest_pages(chapters: DataFrame, asked: DataFrame) -> DataFrame:
    """(book, page, near): the chapter of each asked (book, page), else that of the nearest page within REACH, the lower page first.

    Where chapters overlap the last one to start has the page; an inverted
    range has none. Pages meet by equality.
    """
    start = F.coalesce("page_start", F.lit(0))
    end = F.when(F.coalesce("page_end", F.lit(0)) == 0, start).otherwise(F.col("page_end"))
    spans = chapters.select("book", F.col("id").alias("near"), start.alias("s"), end.alias("e"), "doc_pos")
    page_map = first_by(pages_of(spans, "s", "e"), ["book", "page"], [F.desc("s"), F.desc("doc_pos")]).select("book", F.col("page").alias("at"), "near")
    around = asked.select("book", "page").distinct().withColumn("delta", F.explode(F.sequence(F.lit(-REACH), F.lit(REACH)))).withColumn("at", F.col("page") + F.col("delta"))
    return around.join(page_map, ["book", "at"]).groupBy("book", "page").agg(F.min_by("near", F.struct(F.abs("delta"), F.col("delta") > 0)).alias("near"))


def _turned(df: DataFrame) -> tuple[DataFrame, Column]:
    """Ranges the right way round, and which ones weren't."""
    wrong = F.coalesce((F.col("page_start") > F.col("page_end")) & (F.col("page_end") != 0), F.lit(False))
    return df.withColumns({"page_start": F.when(wrong, F.col("page_end")).otherwise(F.col("page_start")), "page_end": F.when(wrong, F.col("page_start")).otherwise(F.col("page_end"))}), wrong


def _counted(df: DataFrame, change: str) -> DataFrame:
    return df.groupBy("book").agg(F.count(F.lit(1)).alias("n")).select("book", F.lit(change).alias("change"), "n")


def written(c: Curriculum, scratch: Scratch, *parts: str) -> Curriculum:
    """The entities ``parts`` as working tables, so that what reads them several times doesn't make them anew.

    Exercises are by far the most, and a result reads them once or not at all: they are left where they are.
    """
    return c.but(**{part: scratch.keep(getattr(c, part), part) for part in parts})


def fix(c: Curriculum, garbage: Column | None = None, sidebars_by_topic: bool = False) -> tuple[Curriculum, DataFrame]:
    """A cleaned curriculum and the report of its changes (book, change, n).

    Garbage topics go with their subtopics and exercises; sentences about the
    extraction are taken out of summaries; topics of unknown chapters, and those
    whose first page is outside of their chapter, find the chapter of the
    nearest page; inverted ranges turn round; chapters and topics are numbered
    in page order; duplicates go by name or by meaning; subtopics and exercises
    are numbered under their topics, subtopics clamped to the chapter; what
    points at nothing goes. Side boxes follow their chapter; those that name a
    topic only are dropped, or kept with ``sidebars_by_topic``. Edges are
    remapped, single and without self loops, and may still name a removed
    duplicate; a topic's own prerequisites name live topics only.
    """
    garbage = is_garbage(F.col("name"), F.col("summary")) if garbage is None else garbage
    scratch = Scratch(c.topics.sparkSession, "fixer")
    c = written(c, scratch, "chapters", "topics", "subtopics", "edges")
    reports = []
    gone = c.topics.where(garbage)
    reports.append(_counted(gone, "garbage_removed"))
    gone_ids = gone.select("book", F.col("id").alias("topic_id")).distinct()
    texts = {"topics": c.topics.where(~garbage), "subtopics": c.subtopics.join(gone_ids, ["book", "topic_id"], "left_anti"), "exercises": c.exercises.join(gone_ids, ["book", "topic_id"], "left_anti")}
    for part, df in texts.items():
        cleaned = without_meta(F.col("summary"))
        told = df.withColumn("_new", F.when(F.coalesce("summary", F.lit("")) != "", cleaned).otherwise(F.col("summary")))
        reports.append(_counted(told.where("_new <> summary"), "debug_stripped"))
        texts[part] = told.withColumn("summary", F.col("_new")).drop("_new")
    topics, subtopics, exercises = texts.values()

    # Topics without a known chapter, then those outside of their own.
    known = c.chapters.select("book", F.col("id").alias("chapter_id"), F.coalesce("page_start", F.lit(0)).alias("_lo"), F.coalesce("page_end", F.lit(0)).alias("_hi"))
    zero = lambda x: F.when(F.coalesce(F.col(x), F.lit(0)) != 0, F.col(x))
    topics = topics.withColumn("page", F.coalesce(zero("page_start"), zero("page_end"), F.lit(0)))
    near = nearest_pages(c.chapters, topics.select("book", "page").unionByName(topics.select("book", F.col("page_start").alias("page")).where("page IS NOT NULL")))
    near = scratch.keep(near, "near")
    topics = topics.join(known, ["book", "chapter_id"], "left").join(near, ["book", "page"], "left")
    orphan = F.col("_lo").isNull() & F.col("near").isNotNull()
    reports.append(_counted(topics.where(orphan), "orphans_reassigned"))
    topics = scratch.keep(topics.withColumn("chapter_id", F.when(orphan, F.col("near")).otherwise(F.col("chapter_id"))).drop("_lo", "_hi", "near"), "homed")
    topics = topics.join(known, ["book", "chapter_id"], "left").join(near.select("book", F.col("page").alias("page_start"), "near"), ["book", "page_start"], "left")
    outside = (F.col("page_start") < F.col("_lo")) | (F.col("page_start") > F.col("_hi"))
    moved = F.coalesce(outside & (F.col("near") != F.col("chapter_id")), F.lit(False))
    reports.append(_counted(topics.where(moved), "out_of_range_moved"))
    topics = scratch.keep(topics.withColumn("chapter_id", F.when(moved, F.col("near")).otherwise(F.col("chapter_id"))).drop("_lo", "_hi", "near", "page"), "moved")

    turned = {}
    for part, df in (("topics", topics), ("subtopics", subtopics), ("chapters", c.chapters)):
        turned[part], wrong = _turned(df)
        reports.append(_counted(df.where(wrong), "inverted_fixed"))

    chapters = numbered(turned["chapters"], ["book"], [F.coalesce("page_start", F.lit(0)), F.col("id"), F.col("doc_pos")], "_n")
    chapters = scratch.keep(chapters.withColumn("_new", F.concat(F.lit("C_"), F.col("_n").cast("string"))), "numbered")
    reports.append(_counted(chapters.where("id <> _new"), "chapters_renumbered"))
    # An id that two chapters share stands for the later one; one that no chapter has stands for itself.
    chapter_map = chapters.groupBy("book", F.col("id").alias("_old")).agg(F.max_by("_new", "_n").alias("_to"))
    homes = chapters.select("book", F.col("_new").alias("_home"), F.col("_n").alias("_c"), F.coalesce("page_start", F.lit(0)).alias("_lo"), F.coalesce("page_end", F.lit(0)).alias("_hi"))

    def follow(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
        """``column`` by the map (book, _old, _to); what the map doesn't have stays."""
        return df.join(table.withColumnRenamed("_old", column), ["book", column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

    topics = follow(turned["topics"], "chapter_id", chapter_map).join(homes.withColumnRenamed("_home", "chapter_id"), ["book", "chapter_id"], "left")
    reports.append(_counted(topics.where("_c IS NULL"), "dangling_dropped"))
    topics = numbered(topics.where("_c IS NOT NULL"), ["book", "chapter_id"], [F.coalesce("page_start", F.lit(0)), F.col("id"), F.col("doc_pos")], "_t")
    topics = topics.withColumn("_new", F.concat_ws("_", F.lit("T"), F.col("_c").cast("string"), F.col("_t").cast("string")))
    reports.append(_counted(topics.where("id <> _new"), "topics_renumbered"))
    place = F.col("_c").cast("long") * (1 << 32) + F.col("_t")
    topics = topics.withColumn("_at", place).withColumn("_exact", norm_name(F.col("name")))
    meaning = F.concat_ws("|", F.coalesce(F.col("page_start").cast("string"), F.lit("")), semantic_name(F.col("name")))
    topics = scratch.keep(topics.withColumn("_meaning", meaning), "ranked")
    topic_map = topics.groupBy("book", F.col("id").alias("_old")).agg(F.max_by("_new", "_at").alias("_to"))

    judged = scratch.keep(fold_dedup(topics, ["book", "chapter_id"], ["_at"], "_exact", "_meaning", "_at", carry=["book"], why=True), "judged")
    reports.append(_counted(judged.where("gone_by = 'first'"), "duplicates_removed"))
    reports.append(_counted(judged.where("gone_by = 'second'"), "semantic_dupes_removed"))
    topics = topics.join(judged.where("gone_by IS NULL"), ["book", "_at"], "left_semi")
    live = topics.select("book", F.col("_new").alias("topic_id"), "_at", "_lo", "_hi", F.regexp_replace("_new", "^T", "").alias("_tail"))

    def children(df: DataFrame, prefix: str, page: str) -> DataFrame:
        own = follow(df, "topic_id", topic_map).join(live, ["book", "topic_id"], "left")
        reports.append(_counted(own.where("_at IS NULL"), "dangling_dropped"))
        own = numbered(own.where("_at IS NOT NULL"), ["book", "topic_id"], [F.coalesce(page, F.lit(0)), F.col("doc_pos")], "_k")
        return own.withColumn("id", F.concat(F.lit(prefix), F.col("_tail"), F.lit("_"), F.col("_k").cast("string"))).drop("_k", "_tail", "_at")

    subtopics = children(turned["subtopics"], "ST", "page_start")
    low, high = F.coalesce(F.col("page_start") < F.col("_lo"), F.lit(False)), F.coalesce(F.col("page_end") > F.col("_hi"), F.lit(False))
    reports.append(_counted(subtopics.where(low), "ranges_clamped"))
    reports.append(_counted(subtopics.where(high), "ranges_clamped"))
    subtopics = subtopics.withColumns({"page_start": F.when(low, F.col("_lo")).otherwise(F.col("page_start")), "page_end": F.when(high, F.col("_hi")).otherwise(F.col("page_end"))})
    subtopics = subtopics.withColumn("page_end", F.when(F.col("page_start") > F.col("page_end"), F.col("page_start")).otherwise(F.col("page_end"))).drop("_lo", "_hi")
    exercises = children(exercises, "E", "page").drop("_lo", "_hi")

    sidebars = c.sidebars
    if sidebars_by_topic:
        of = topics.select("book", F.col("_new").alias("_t"), F.col("chapter_id").alias("_of"))
        sidebars = follow(sidebars, "topic_id", topic_map).join(of.withColumnRenamed("_t", "topic_id"), ["book", "topic_id"], "left")
        placed = follow(sidebars.where("_of IS NULL"), "chapter_id", chapter_map).drop("_of")
        sidebars = placed.unionByName(sidebars.where("_of IS NOT NULL").withColumn("chapter_id", F.col("_of")).drop("_of"))
    else:
        sidebars = follow(sidebars, "chapter_id", chapter_map)
    sidebars = sidebars.join(homes.select("book", F.col("_home").alias("chapter_id")), ["book", "chapter_id"], "left_semi")

    ids = chapter_map.where("startswith(_old, 'C_')").unionByName(topic_map.where("startswith(_old, 'T_')"))
    edges = follow(follow(c.edges, "child", ids), "parent", ids).where("child <> parent")
    edges = first_by(edges, ["book", "graph", "child", "parent", "kind"], [F.col("doc_pos")])

    refs = topics.select("book", "_at", F.posexplode("prerequisites").alias("_pos", "ref"))
    refs = follow(refs, "ref", ids).join(live.select("book", F.col("topic_id").alias("ref")), ["book", "ref"], "left_semi")
    lists = refs.groupBy("book", "_at").agg(F.sort_array(F.collect_list(F.struct("_pos", "ref"))).alias("_refs"))
    needs = F.coalesce(F.transform("_refs", lambda x: x["ref"]), F.array().cast("array<string>"))
    topics = topics.join(lists, ["book", "_at"], "left").withColumns({"prerequisites": needs, "id": F.col("_new")})
    report = reports[0]
    for one in reports[1:]:
        report = report.unionByName(one)
    report = report.groupBy("book", "change").agg(F.sum("n").alias("n"))
    named = chapters.withColumns({"id": F.col("_new"), "number": F.col("_n")}).drop("_new", "_n")
    return Curriculum(named, topics.select(*c.topics.columns), subtopics.select(*c.subtopics.columns), exercises.select(*c.exercises.columns), sidebars.select(*c.sidebars.columns), edges), report


def enrich(c: Curriculum) -> tuple[Curriculum, DataFrame]:
    """A curriculum with activity types, concept tags, activity lists of chapters and edges between types, and the report (book, change, n)."""
    c = written(c, Scratch(c.topics.sparkSession, "enricher"), "chapters", "topics", "edges")
    topics = with_concepts(with_activity(c.topics, "canonical_type"))
    rank = F.create_map(*[F.lit(x) for kv in ACTIVITY_ORDER.items() for x in kv])[F.col("canonical_type")]
    order = W.partitionBy("book", "chapter_id").orderBy("_rank", F.coalesce("page_start", F.lit(0)), "doc_pos")
    ranked = topics.withColumn("_rank", F.coalesce(rank, F.lit(99)))
    linked = ranked.select("book", "doc_pos", F.col("id").alias("child"), F.lag("id").over(order).alias("parent"), "canonical_type", F.lag("canonical_type").over(order).alias("_before"))
    new = linked.where("_before <> canonical_type AND child <> parent").select("book", "doc_pos", F.lit("concept_dependencies").alias("graph"), "child", "parent", F.lit("depends_on").alias("kind"))
    keys = ["book", "graph", "child", "parent", "kind"]
    new = first_by(new.join(c.edges.select(*keys), keys, "left_anti"), keys, [F.col("doc_pos")])
    kinds = topics.groupBy("book", F.col("chapter_id").alias("id")).agg(F.array_sort(F.collect_set("canonical_type")).alias("activity_summary"))
    chapters = c.chapters.join(kinds, ["book", "id"], "left").withColumn("activity_summary", F.coalesce("activity_summary", F.array().cast("array<string>")))
    chapters = chapters.withColumn("missing_activities", F.array_sort(F.array_except(F.array(*map(F.lit, STANDARD)), F.col("activity_summary"))))
    report = _counted(topics, "canonical_typed").unionByName(_counted(topics, "concepts_added")).unionByName(_counted(new, "prereq_edges_added"))
    report = report.unionByName(_counted(chapters, "chapters_summarised")).unionByName(_counted(chapters.where(F.size("missing_activities") > 0), "missing_warnings"))
    return c.but(topics=topics, chapters=chapters, edges=c.edges.unionByName(new.select(*c.edges.columns))), report


@dataclass(frozen=True)
class Validated:
    """A validated curriculum, the chapters set apart, and recurring titles (book, title, sections)."""

    curriculum: Curriculum
    unresolved: DataFrame
    quarantined: DataFrame
    groups: DataFrame


#: Chapters of a lower confidence are set apart.
TRUSTED = 0.6
#: A single topic over more pages is suspicious.
DENSE = 8
OPEN = 9999


def status_of(confidence: Column) -> Column:
    return F.when(confidence >= 0.8, "verified").when(confidence >= 0.4, "partial").otherwise("unverified")


def validate(c: Curriculum, mode: str = "full") -> Validated:
    """Structure made sound.

    ``full`` sets chapters without a first page apart, infers prerequisites
    from the chapter before, classifies exercises and subtopics, groups
    recurring titles and sets chapters of low confidence apart. ``light`` keeps
    chapters that start at page 0, sets the confidence of an empty chapter to
    0.2, deduplicates side boxes and does none of the rest.

    Of chapters that start on one page the one with most topics stays, the
    first on ties; neighbours of one title become one; topics that pointed at
    any of them follow to the one that is left. Ends are monotone; topics, then
    exercises, are single; pages are clamped to the parent's; prerequisites
    name live topics and have no cycles.
    """
    full = mode == "full"
    scratch = Scratch(c.topics.sparkSession, "validator")
    c = written(c, scratch, "chapters", "topics")
    counts = c.topics.groupBy("book", F.col("chapter_id").alias("id")).agg(F.count(F.lit(1)).alias("_topics"))
    start = F.coalesce("page_start", F.lit(0))
    sound = start > 0 if full else F.col("page_start").isNotNull()
    phantoms = c.chapters.where(~sound).withColumns({"confidence": F.lit(0.0), "status": F.lit("unverified")})
    chapters = c.chapters.where(sound).withColumn("_sort", F.when(start == 0, OPEN).otherwise(start)).join(counts, ["book", "id"], "left")
    richest = W.partitionBy("book", "page_start").orderBy(F.coalesce("_topics", F.lit(0)).desc(), "doc_pos")
    chapters = chapters.withColumn("_keeper", F.first("id").over(richest)).withColumn("_nth", F.row_number().over(richest))
    same_start = chapters.select("book", F.col("id").alias("_old"), F.col("_keeper").alias("_mid"))
    title = stripped(F.coalesce("title", F.lit("")))
    title = stripped(F.regexp_replace(title, r"(?i)\s*\(Part \d+\)\s*$", "")) if full else title
    chapters = chapters.where("_nth = 1").withColumn("_title", title)
    chapters = islands(chapters, ["book"], [F.col("_sort"), F.col("doc_pos")], "_title", "_island")
    run = W.partitionBy("book", "_island")
    inside = run.orderBy("_sort", "doc_pos")
    zero = lambda x: F.when(F.coalesce(F.col(x), F.lit(0)) != 0, F.col(x))
    end = F.coalesce(zero("page_end"), zero("page_start"), F.lit(0))
    chapters = chapters.withColumns({"_first": F.first("id").over(inside), "_place": F.row_number().over(inside), "_size": F.count(F.lit(1)).over(run), "_last": F.max(end).over(run)})
    remap = same_start.join(chapters.select("book", F.col("id").alias("_mid"), F.col("_first").alias("_to")), ["book", "_mid"]).select("book", "_old", "_to")
    chapters = chapters.where("_place = 1").withColumn("page_end", F.when(F.col("_size") > 1, F.col("_last")).otherwise(F.col("page_end")))
    ordered = W.partitionBy("book").orderBy("_sort", "doc_pos")
    chapters = chapters.withColumn("_next", F.lead("page_start").over(ordered)).withColumn("number", F.row_number().over(ordered))
    collapsed = F.coalesce(F.col("_next") - 1 < F.col("page_start"), F.lit(False))
    chapters = chapters.withColumn("page_end", F.when(F.col("_next").isNotNull(), F.greatest("page_start", F.col("_next") - 1)).otherwise(F.col("page_end")))
    short = F.coalesce("page_end", F.lit(0)) < F.coalesce("page_start", F.lit(0))
    halves = F.when(collapsed, 0.5).otherwise(1.0) * F.when(short, 0.5).otherwise(1.0) if full else F.lit(1.0)
    chapters = chapters.withColumn("confidence", round_half_up(halves)).withColumn("page_end", F.when(short, F.col("page_start")).otherwise(F.col("page_end")))
    if full:
        chapters = chapters.withColumn("title", F.col("_title"))
    chapters, remap = scratch.keep(chapters, "ordered"), scratch.keep(remap, "remap")

    key = (lambda x: F.lower(stripped(F.coalesce(F.col(x), F.lit(""))))) if full else (lambda x: F.lower(normalised(F.coalesce(F.col(x), F.lit("")))))
    head = (lambda x: F.lower(F.substring(stripped(F.coalesce(F.col(x), F.lit(""))), 1, 80))) if full else (lambda x: F.lower(F.substring(normalised(F.coalesce(F.col(x), F.lit(""))), 1, 80)))

    def follow(df: DataFrame, column: str, table: DataFrame) -> DataFrame:
        return df.join(table.withColumnRenamed("_old", column), ["book", column], "left").withColumn(column, F.coalesce("_to", column)).drop("_to")

    topics = follow(c.topics, "chapter_id", remap).withColumn("_key", key("name"))
    same = W.partitionBy("book", F.coalesce("chapter_id", F.lit("")), "_key").orderBy("doc_pos")
    topics = topics.withColumns({"_to": F.first("id").over(same), "_nth": F.row_number().over(same)})
    topic_map = topics.where("_nth > 1").groupBy("book", F.col("id").alias("_old")).agg(F.max_by("_to", "doc_pos").alias("_to"))
    topics = topics.where("_nth = 1").drop("_key", "_to", "_nth")
    subtopics, exercises, sidebars = (follow(df, "topic_id", topic_map) for df in (c.subtopics, c.exercises, c.sidebars))
    single = lambda df: first_by(df.withColumn("_key", head("text")).withColumn("_of", F.coalesce("topic_id", F.lit(""))), ["book", "_of", "_key"], [F.col("doc_pos")]).drop("_key", "_of")
    exercises = single(exercises)
    if full:
        topics = topics.where(F.coalesce("page_start", F.lit(0)) != 0)
    else:
        sidebars = single(sidebars)

    bounds = chapters.select("book", F.col("id").alias("chapter_id"), F.coalesce("page_start", F.lit(0)).alias("_lo"), F.coalesce(zero("page_end"), F.lit(OPEN)).alias("_hi"))
    topics = scratch.keep(_inside(topics.join(bounds, ["book", "chapter_id"], "left").na.fill({"_lo": 0, "_hi": OPEN}), full), "inside")
    ranges = topics.groupBy("book", F.col("id").alias("topic_id")).agg(F.max(F.coalesce("page_start", F.lit(0))).alias("_lo"), F.max(F.coalesce(zero("page_end"), F.lit(OPEN))).alias("_hi"))
    subtopics = _inside(subtopics.join(ranges, ["book", "topic_id"], "left").na.fill({"_lo": 0, "_hi": OPEN}), full).drop("boundary_violation")

    held = topics.groupBy("book", F.col("chapter_id").alias("id")).agg(F.count(F.lit(1)).alias("_n"))
    chapters = chapters.join(held, ["book", "id"], "left")
    pages = F.greatest(F.lit(1), F.coalesce("page_end", F.lit(0)) - F.coalesce("page_start", F.lit(0)) + 1)
    sparse = (F.col("_n") == 1) & (pages > DENSE)
    empty = round_half_up(F.col("confidence") * 0.3) if full else F.lit(0.2)
    chapters = chapters.withColumn("confidence", F.when(F.col("_n").isNull(), empty).when(sparse, round_half_up(F.col("confidence") * 0.7)).otherwise(F.col("confidence")))
    chapters = scratch.keep(chapters.withColumn("status", status_of(F.col("confidence"))), "graded")

    ids = topics.select("book", F.col("id").alias("ref")).distinct()
    shape = F.col("ref").startswith("T_") if full else F.col("ref").rlike(r"^T_\d+_\d+$")
    refs = topics.select("book", "doc_pos", "id", F.posexplode("prerequisites").alias("_pos", "ref")).where(shape).join(ids, ["book", "ref"], "left_semi")
    if full:
        # A topic without any needs the last topic of the nearest earlier chapter that has topics.
        lasts = topics.groupBy("book", "chapter_id").agg(F.max_by("id", "doc_pos").alias("_tail"))
        line = chapters.select("book", F.col("id").alias("chapter_id"), "number").join(lasts, ["book", "chapter_id"], "left")
        line = line.withColumn("_near", F.last("_tail", True).over(W.partitionBy("book").orderBy("number").rowsBetween(W.unboundedPreceding, -1)))
        bare = topics.select("book", "doc_pos", "id", "chapter_id").join(refs.select("book", "doc_pos").distinct(), ["book", "doc_pos"], "left_anti")
        inferred = bare.join(line.select("book", "chapter_id", "_near"), ["book", "chapter_id"]).where("_near IS NOT NULL AND _near <> id")
        refs = refs.unionByName(inferred.select("book", "doc_pos", "id", F.lit(0).alias("_pos"), F.col("_near").alias("ref")))
    refs = scratch.keep(refs, "refs")
    kept = break_cycles(refs.select(F.col("book").alias("group"), F.col("doc_pos").alias("pos"), F.col("id").alias("child"), F.col("ref").alias("parent")))
    kept = scratch.keep(kept.select(F.col("group").alias("book"), F.col("child").alias("id"), F.col("parent").alias("ref")), "acyclic")
    before = refs.select("book", "id", "ref").distinct().groupBy("book").agg(F.count(F.lit(1)).alias("_all"))
    after = kept.groupBy("book").agg(F.count(F.lit(1)).alias("_left"))
    broken = before.join(after, "book").select("book", (F.col("_all") > F.col("_left")).alias("_broken"))
    told = refs.join(kept.withColumn("_stays", F.lit(True)), ["book", "id", "ref"], "left").groupBy("book", "doc_pos").agg(
        F.sort_array(F.collect_list(F.struct("_pos", "ref"))).alias("_listed"), F.array_sort(F.collect_set(F.when(F.col("_stays"), F.col("ref")))).alias("_sorted")
    )
    none = F.array().cast("array<string>")
    needs = F.when(F.coalesce("_broken", F.lit(False)), F.coalesce("_sorted", none)).otherwise(F.coalesce(F.transform("_listed", lambda x: x["ref"]), none))
    topics = topics.join(told, ["book", "doc_pos"], "left").join(broken, "book", "left").withColumn("prerequisites", needs).drop("_listed", "_sorted", "_broken")

    section = F.struct("number", F.col("id").alias("chapter_id"), "page_start", "page_end")
    groups = chapters.groupBy("book", "title").agg(F.sort_array(F.collect_list(section)).alias("sections")).where(F.size("sections") > 1)
    low = chapters.limit(0)
    if full:
        exercises = exercises.withColumn("exercise_type", first_keyword(F.lower(F.coalesce("text", F.lit(""))), rules(EXERCISES), "general_activity"))
        about = F.lower(F.concat_ws(" ", F.coalesce("name", F.lit("")), F.coalesce("summary", F.lit(""))))
        subtopics = subtopics.withColumn("skill_type", first_keyword(about, rules(SKILLS), "general_skill"))
        low = chapters.where(F.col("confidence") < TRUSTED)
        chapters = numbered(chapters.where(F.col("confidence") >= TRUSTED).drop("number"), ["book"], [F.col("_sort"), F.col("doc_pos")], "number")
    columns = [*[x for x in c.chapters.columns], "confidence", "status"]
    return Validated(
        Curriculum(chapters.select(*columns), topics, subtopics, exercises, sidebars, c.edges), phantoms.select(*columns), low.select(*columns), groups if full else groups.limit(0)
    )


def _inside(df: DataFrame, full: bool) -> DataFrame:
    """Page ranges clamped to (_lo, _hi), with ``boundary_violation``: the range began after its parent's end."""
    start, end = F.coalesce("page_start", F.lit(0)), F.coalesce("page_end", F.lit(0))
    shut = F.col("_hi") < OPEN
    late = (start > 0) & (F.col("_lo") > 0) & shut & (start > F.col("_hi")) if full else F.lit(False)
    early = (start > 0) & (start < F.col("_lo"))
    early = early & shut if full else early
    out = df.withColumn("_s", F.when(late | early, F.col("_lo")).otherwise(F.col("page_start")))
    past = (end > F.col("_hi")) & shut if full else end > F.col("_hi")
    out = out.withColumn("_e", F.when(past, F.col("_hi")).otherwise(F.col("page_end")))
    wrong = (F.coalesce("_s", F.lit(0)) > F.coalesce("_e", F.lit(0))) & ((F.coalesce("_e", F.lit(0)) != 0) if full else F.lit(True))
    out = out.withColumn("_e", F.when(wrong, F.col("_s")).otherwise(F.col("_e")))
    return out.withColumns({"page_start": F.col("_s"), "page_end": F.col("_e"), "boundary_violation": late}).drop("_s", "_e", "_lo", "_hi")


def clamped(c: Curriculum) -> Curriculum:
    """Topics inside their chapters' pages; an open chapter end (null) doesn't clamp."""
    bounds = c.chapters.select("book", F.col("id").alias("chapter_id"), F.col("page_start").alias("_lo"), F.coalesce("page_end", F.lit(9999)).alias("_hi"))
    start, end, violated = clamp_range(F.col("page_start"), F.col("page_end"), F.col("_lo"), F.col("_hi"))
    topics = c.topics.join(bounds, ["book", "chapter_id"]).withColumns({"violated": violated, "_s": start, "_e": end})
    return c.but(topics=topics.withColumns({"page_start": F.col("_s"), "page_end": F.col("_e")}).drop("_s", "_e", "_lo", "_hi"))


def _tasks(exercises: DataFrame) -> int | None:
    """Partitions of SHARE exercises each, or None if those that Spark makes hold no more.

    A task sorts its lists of exercises by topic, by piece and by chapter: with too many of them its sorter spills pages
    by the hundred and can't hold a buffer for each when it merges them.
    """
    n = -(-exercises.count() // SHARE)
    return n if n > int(exercises.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def _dealt(df: DataFrame, n: int | None, *keys: str) -> DataFrame:
    return df if n is None else df.repartition(n, *keys)


def _cut(topics: DataFrame, stretch: int) -> DataFrame:
    """Topics with ``_piece``: the place, from 0, of their stretch in the chapter."""
    place = F.row_number().over(W.partitionBy("book", "chapter_id").orderBy("doc_pos", "name")) - 1
    return topics.withColumn("_piece", F.floor(place / stretch).cast("int"))


def _stretches(topics: DataFrame, chapters: DataFrame, order: list[Column], topic: Column, chapter: Callable[[], Column], stretch: int) -> DataFrame:
    """(book, first_chapter, first_topic, chapters): a row for each piece of a chapter's topics, so that neither a book nor a chapter has to fit into one."""
    pieces = topics.groupBy("book", F.col("chapter_id").alias("id"), "_piece").agg(F.sort_array(F.collect_list(topic)).alias("topics"))
    numbers = chapters.withColumn("first_chapter", F.row_number().over(W.partitionBy("book").orderBy(*order)) - 1)
    whole = numbers.join(pieces, ["book", "id"], "left")
    return whole.select("book", "first_chapter", F.coalesce(F.col("_piece") * stretch, F.lit(0)).alias("first_topic"), F.array(chapter()).alias("chapters"))


def nested(c: Curriculum, stretch: int | None = None) -> DataFrame:
    """(book, chapters): the legacy form, chapters by number, topics and exercises in document order.

    With ``stretch`` a book comes in rows of at most so many topics of a chapter, with ``first_chapter`` and ``first_topic``.
    """
    n = _tasks(c.exercises)
    texts = _dealt(c.exercises, n, "book", "topic_id").groupBy("book", "topic_id").agg(F.sort_array(F.collect_list(F.struct("doc_pos", "id", "text"))).alias("exercises"))
    topics = c.topics if stretch is None else _cut(c.topics, stretch)  # while they are short
    topics = topics.join(texts.withColumnRenamed("topic_id", "id"), ["book", "id"], "left")
    topic = F.struct("doc_pos", F.col("name").alias("topic_name"), "summary", F.coalesce(F.transform("exercises", lambda x: x["text"]), F.array().cast("array<string>")).alias("exercises"))
    chapter = lambda: F.struct("number", F.col("title").alias("chapter_name"), "topics")
    if stretch is not None:
        return _stretches(_dealt(topics, n, "book", "chapter_id", "_piece"), c.chapters, [F.col("number"), F.col("title")], topic, chapter, stretch)
    by_chapter = topics.groupBy("book", "chapter_id").agg(F.sort_array(F.collect_list(topic)).alias("topics"))
    chapters = c.chapters.join(by_chapter.withColumnRenamed("chapter_id", "id"), ["book", "id"], "left")
    return chapters.groupBy("book").agg(F.sort_array(F.collect_list(chapter())).alias("chapters"))


def nested_whole(c: Curriculum, stretch: int | None = None) -> DataFrame:
    """(book, chapters): the nested form with all that topics hold.

    Chapters go by number, those without one last, topics in document order;
    exercises and side boxes as the topic's arrays of ids have them, subtopics in
    document order. Topics of unknown chapters go. With ``stretch`` a book comes
    in rows as nested() has them.
    """
    topics = resolve_arrays(c.topics, ["book", "id"], {"exercise_ids": c.exercises, "sidebar_ids": c.sidebars}, ["text", "page"], ["book"])
    below = F.struct("doc_pos", F.col("name").alias("subtopic_name"), "summary", "page_start", "page_end")
    subtopics = c.subtopics.groupBy("book", F.col("topic_id").alias("id")).agg(F.sort_array(F.collect_list(below)).alias("subtopics"))
    topic = F.struct(
        "doc_pos", F.col("name").alias("topic_name"), F.col("summary").alias("concept_summary"), "page_start", "page_end",
        F.transform("subtopics", lambda x: x.dropFields("doc_pos")).alias("subtopics"), F.coalesce("prerequisites", F.array().cast("array<string>")).alias("prerequisites"),
        F.col("exercise_ids").alias("original_exercises"), F.col("sidebar_ids").alias("details_and_sidebars"), F.lit("untaught").alias("status"),
    )
    told = topics.join(subtopics, ["book", "id"], "left")
    rank = F.coalesce(F.nullif("number", F.lit(0)), F.lit(999))

    def chapter() -> Column:
        held = F.transform(F.coalesce("topics", F.array()), lambda t: t.dropFields("doc_pos"))
        return F.struct(rank.alias("rank"), "doc_pos", F.col("number").alias("chapter_number"), F.col("title").alias("chapter_title"), "page_start", "page_end", held.alias("topics"))

    if stretch is not None:
        whole = _stretches(_cut(told, stretch), c.chapters, [rank, F.col("doc_pos")], topic, chapter, stretch)
    else:
        grouped = told.groupBy("book", F.col("chapter_id").alias("id")).agg(F.sort_array(F.collect_list(topic)).alias("topics"))
        whole = c.chapters.join(grouped, ["book", "id"], "left").groupBy("book").agg(F.sort_array(F.collect_list(chapter())).alias("chapters"))
    return whole.withColumn("chapters", F.transform("chapters", lambda x: x.dropFields("rank", "doc_pos")))
