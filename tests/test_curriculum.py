"""The fixer and the validator against plain versions over random curricula, and what a second run changes."""

from __future__ import annotations

import difflib
import json
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from chalkline.operators.curriculum import fix, validate
from chalkline.plans.language import alike_pairs
from chalkline.sources.documents import parse_strict

NAMES = ["Birds", "birds ", "1. Birds", "Birds (story)", "Trees", "Trees", "N/A", "no content found", "", "Rain"]
SUMMARIES = [None, "", "Fine.", "The provided image is empty", "One. This page belongs to another chapter. Two.", "One. NOTE: cut"]


def random_book(r):
    page = lambda: r.choice([None, 0, *range(1, 40)])
    chapters = [{"id": f"C_{i}", "number": i, "title": r.choice("ABAB"), "page_start": page(), "page_end": page()} for i in r.sample(range(1, 9), 4)]
    ids = [f"T_{i}" for i in range(14)]
    topics = [
        {"id": i, "name": r.choice(NAMES), "summary": r.choice(SUMMARIES), "chapter_id": r.choice([*(c["id"] for c in chapters), "C_9", "gone"]), "page_start": page(), "page_end": page(), "prerequisites": r.sample(ids, 2)}
        for i in ids
    ]
    near = [*ids, "T_1_1", "T_2_1", "nowhere"]
    subtopics = [{"id": f"ST_{i}", "name": "s", "summary": r.choice(SUMMARIES), "topic_id": r.choice(near), "page_start": page(), "page_end": page()} for i in range(12)]
    exercises = [{"id": f"E_{i}", "text": r.choice("xyz") * 3, "topic_id": r.choice(near), "page": r.choice([None, 1, 2])} for i in range(20)]
    edges = [{"from": r.choice([*ids, "C_1"]), "to": r.choice(ids), "type": "needs"} for _ in range(20)]
    return {"entities": {"chapters": chapters, "topics": topics, "subtopics": subtopics, "exercises": exercises, "sidebars": []}, "graphs": {"concept_dependencies": edges}}


def norm(name):
    return name.strip().lower()


def meaning(name):
    return re.sub(r"\s*\([^)]*\)\s*$", "", re.sub(r"^\d+\.\s*", "", norm(name))).strip()


def nearest(chapters, page):
    owner = {}
    for c in sorted(chapters, key=lambda c: c["page_start"] or 0):
        for p in range(c["page_start"] or 0, (c["page_end"] or c["page_start"] or 0) + 1):
            owner[p] = c["id"]
    for d in range(20):
        for p in (page - d, page + d):
            if p in owner:
                return owner[p]
    return None


def plain_fix(book):
    """(topics, subtopics, exercises, edges, counts of changes) as tuples."""
    e, counts = book["entities"], Counter()
    bad = lambda t: norm(t["name"]) in ("", "n/a", "no content found") or norm(t["summary"] or "").startswith("the provided image")
    gone = {t["id"] for t in e["topics"] if bad(t)}
    counts["garbage_removed"] += sum(map(bad, e["topics"]))
    topics = [dict(t) for t in e["topics"] if not bad(t)]
    subs, exs = ([dict(x) for x in e[k] if x["topic_id"] not in gone] for k in ("subtopics", "exercises"))
    counts["debug_stripped"] += sum(len(x["summary"] or "") > 30 or "NOTE" in (x["summary"] or "") for x in [*topics, *subs] if not (x["summary"] or "").startswith("The provided"))
    known = {c["id"]: c for c in e["chapters"]}
    for t in topics:
        if t["chapter_id"] not in known and (to := nearest(e["chapters"], t["page_start"] or t["page_end"] or 0)):
            t["chapter_id"] = to
            counts["orphans_reassigned"] += 1
    for t in topics:
        c, p = known.get(t["chapter_id"]), t["page_start"]
        if c and p is not None and not (c["page_start"] or 0) <= p <= (c["page_end"] or 0):
            to = nearest(e["chapters"], p)
            if to and to != t["chapter_id"]:
                t["chapter_id"] = to
                counts["out_of_range_moved"] += 1
    chapters = [dict(c) for c in e["chapters"]]
    for x in [*topics, *subs, *chapters]:
        a, b = x["page_start"], x["page_end"]
        if a and b and a > b:
            x["page_start"], x["page_end"] = b, a
            counts["inverted_fixed"] += 1
    chapters.sort(key=lambda c: (c["page_start"] or 0, c["id"]))
    new_chapter = {c["id"]: f"C_{i}" for i, c in enumerate(chapters, 1)}
    by_new = {f"C_{i}": (i, c["page_start"] or 0, c["page_end"] or 0) for i, c in enumerate(chapters, 1)}
    counts["chapters_renumbered"] += sum(a != b for a, b in new_chapter.items())
    home = lambda t: new_chapter.get(t["chapter_id"], t["chapter_id"])
    counts["dangling_dropped"] += sum(home(t) not in by_new for t in topics)
    new_topic, order, kept, exact, alike = {}, Counter(), [], set(), set()
    for t in sorted((t for t in topics if home(t) in by_new), key=lambda t: (by_new[home(t)][0], t["page_start"] or 0, t["id"])):
        c = home(t)
        order[c] += 1
        new = f"T_{by_new[c][0]}_{order[c]}"
        new_topic[t["id"]] = new
        counts["topics_renumbered"] += new != t["id"]
        k1, k2 = (c, norm(t["name"])), (c, t["page_start"], meaning(t["name"]))
        if k1 in exact:
            counts["duplicates_removed"] += 1
        elif k2 in alike:
            counts["semantic_dupes_removed"] += 1
        else:
            exact.add(k1)
            alike.add(k2)
            kept.append((new, c, t))
    place = {new: i for i, (new, _, _) in enumerate(kept)}
    of = {new: c for new, c, _ in kept}

    def children(rows, prefix, page):
        out, n = [], Counter()
        for x in sorted((x for x in rows if new_topic.get(x["topic_id"], x["topic_id"]) in place), key=lambda x: (place[new_topic.get(x["topic_id"], x["topic_id"])], x[page] or 0)):
            to = new_topic.get(x["topic_id"], x["topic_id"])
            n[to] += 1
            out.append((f"{prefix}{to[1:]}_{n[to]}", to, x))
        counts["dangling_dropped"] += len(rows) - len(out)
        return out

    told = []
    for new, to, x in children(subs, "ST", "page_start"):
        _, low, high = by_new[of[to]]
        a, b = x["page_start"], x["page_end"]
        counts["ranges_clamped"] += (a is not None and a < low) + (b is not None and b > high)
        a = low if a is not None and a < low else a
        b = high if b is not None and b > high else b
        told.append((new, to, a, a if a is not None and b is not None and a > b else b))
    follow = lambda i: (new_chapter if i[0] == "C" else new_topic).get(i, i)
    edges = {(follow(x["from"]), follow(x["to"])) for x in book["graphs"]["concept_dependencies"]}
    return (
        sorted((new, c, t["name"], tuple(p for p in map(follow, t["prerequisites"]) if p in place)) for new, c, t in kept),
        sorted(told, key=str),
        sorted((new, to, x["text"]) for new, to, x in children(exs, "E", "page")),
        sorted(x for x in edges if x[0] != x[1]),
        {k: n for k, n in counts.items() if n},
    )


def test_fix_against_plain(spark):
    r = random.Random(12)
    books = {f"b{i}": random_book(r) for i in range(25)}
    c = parse_strict(spark.createDataFrame([(k, json.dumps(b)) for k, b in books.items()], "book string, document string"))
    fixed, report = fix(c)
    by = lambda rows: {k: [x[1:] for x in rows if x[0] == k] for k in books}
    topics = by([(t["book"], t["id"], t["chapter_id"], t["name"], tuple(t["prerequisites"])) for t in fixed.topics.collect()])
    subtopics = by([(s["book"], s["id"], s["topic_id"], s["page_start"], s["page_end"]) for s in fixed.subtopics.collect()])
    exercises = by([(x["book"], x["id"], x["topic_id"], x["text"]) for x in fixed.exercises.collect()])
    edges = by([(x["book"], x["child"], x["parent"]) for x in fixed.edges.collect()])
    counts = by([(x["book"], x["change"], x["n"]) for x in report.collect()])
    for k, book in books.items():
        want = plain_fix(book)
        assert (sorted(topics[k]), sorted(subtopics[k], key=str), sorted(exercises[k]), sorted(edges[k]), dict(counts[k])) == want


def plain_validate(book):
    """(chapters, topics with their prerequisites) of the full mode, the topics' cycles left out of account."""
    e = book["entities"]
    valid = sorted((dict(c) for c in e["chapters"] if (c["page_start"] or 0) > 0), key=lambda c: c["page_start"])
    n = Counter(t["chapter_id"] for t in e["topics"])
    best = {}
    for c in valid:
        k = best.get(c["page_start"])
        if k is None or n[c["id"]] > n[k["id"]]:
            best[c["page_start"]] = c
    to = {c["id"]: best[c["page_start"]]["id"] for c in valid}
    runs = []
    for c in (best[s] for s in sorted(best)):
        if runs and runs[-1][0]["title"] == c["title"]:
            runs[-1].append(c)
        else:
            runs.append([c])
    last = {c["id"]: run[0]["id"] for run in runs for c in run}
    chapters = []
    for i, run in enumerate(runs):
        c = run[0]
        end = max(x["page_end"] or x["page_start"] for x in run) if len(run) > 1 else c["page_end"]
        end = max(c["page_start"], runs[i + 1][0]["page_start"] - 1) if i + 1 < len(runs) else end
        short = (end or 0) < c["page_start"]
        chapters.append([c["id"], c["page_start"], c["page_start"] if short else end, 0.5 if short else 1.0])
    seen, topics = set(), []
    for t in e["topics"]:
        home = last.get(to.get(t["chapter_id"]), t["chapter_id"])
        if (home, norm(t["name"])) not in seen:
            seen.add((home, norm(t["name"])))
            if t["page_start"]:
                topics.append((t["id"], home))
    held = Counter(h for _, h in topics)
    for c in chapters:
        pages = max(1, (c[2] or 0) - c[1] + 1)
        factor = 0.3 if not held[c[0]] else 0.7 if held[c[0]] == 1 and pages > 8 else 1.0
        c[3] = round(c[3] * factor + 1e-9, 2)
    sound = [(c, a, b, f) for c, a, b, f in chapters if f >= 0.6]
    return [(c, i, a, b, f) for i, (c, a, b, f) in enumerate(sound, 1)], sorted(topics), sorted(c for c, _, _, f in chapters if f < 0.6)


@pytest.fixture(scope="module")
def many(spark):
    r = random.Random(21)
    books = {f"b{i}": random_book(r) for i in range(25)}
    return books, spark.createDataFrame([(k, json.dumps(b)) for k, b in books.items()], "book string, document string")


def test_validate_against_plain(many):
    books, raw = many
    found = validate(parse_strict(raw))
    chapters, topics, low = found.curriculum.chapters.collect(), found.curriculum.topics.collect(), found.quarantined.collect()
    for k, book in books.items():
        own = lambda rows: [x for x in rows if x["book"] == k]  # noqa: E731, B023
        told = sorted((c["number"], c["id"], c["page_start"], c["page_end"], c["confidence"]) for c in own(chapters))
        want = plain_validate(book)
        assert [(c, i, a, b, f) for i, c, a, b, f in told] == want[0]
        assert sorted((t["id"], t["chapter_id"]) for t in own(topics)) == want[1]
        assert sorted(c["id"] for c in own(low)) == want[2]
        ids = {t["id"] for t in own(topics)}
        needs = {t["id"]: set(t["prerequisites"]) for t in own(topics)}
        assert all(p in ids for own_ in needs.values() for p in own_)
        while needs:  # no cycles: there is always a topic whose needs are met
            met = [i for i, p in needs.items() if not p & needs.keys()]
            assert met
            for i in met:
                del needs[i]
        for t in own(topics):
            if t["page_start"] and t["page_end"]:
                assert t["page_start"] <= t["page_end"]


def test_fix_again_changes_nothing(spark):
    """Over what the fixer gives it changes nothing but numbers, as ids of one page are compared as text (T_1_10 before T_1_2)."""
    r = random.Random(5)
    chapters = [{"id": f"C_{i}", "number": i, "title": str(i), "page_start": 10 * i, "page_end": 10 * i + 9} for i in (3, 1, 2)]
    topics = [{"id": f"x{i}", "name": f"{r.choice(NAMES)} {i // 2}", "summary": "s", "chapter_id": f"C_{1 + i % 3}", "page_start": 10 * (1 + i % 3) + i % 7, "page_end": 10 * (1 + i % 3) + 9, "prerequisites": []} for i in range(30)]
    book = {"entities": {"chapters": chapters, "topics": topics, "subtopics": [], "exercises": [{"id": "e", "text": "t", "topic_id": "x5", "page": 1}], "sidebars": []}, "graphs": {}}
    once, _ = fix(parse_strict(spark.createDataFrame([("b", json.dumps(book))], "book string, document string")))
    again, report = fix(once)
    assert report.where("change <> 'topics_renumbered'").isEmpty()
    assert sorted(x["name"] for x in again.topics.collect()) == sorted(x["name"] for x in once.topics.collect())


def test_alike_names_against_all_pairs(spark):
    r = random.Random(3)
    rows = [(r.choice("gh"), i, "".join(r.choices("abc", k=r.randrange(0, 9)))) for i in range(120)]
    found = alike_pairs(spark.createDataFrame(rows, "g string, topic_id long, name string"), ["g"], "topic_id", "name", 0.7).collect()
    ratio = lambda a, b: difflib.SequenceMatcher(None, a, b).ratio()
    want = {(i, j, ratio(a, b)) for g, i, a in rows for h, j, b in rows if g == h and i < j and ratio(a, b) >= 0.7}
    assert {(x["topic_id"], x["other_id"], x["ratio"]) for x in found} == want and len(found) == len(want)
