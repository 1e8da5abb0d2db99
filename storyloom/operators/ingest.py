"""Structured results of reading chapters put into a knowledge base.

A batch holds at most one result a chapter. A chapter that was done before is read again: its facts are
compared with the old ones, the rest is replaced. Any other chapter is read first: what it left behind is removed and all is
added. What to do is decided by the status before the batch, and a batch changes each table once, so it is committed whole or not at all.

Everything is joins on (book, name), (chapter, fact) or ids; lists are no longer than what one chapter says of one name.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storyloom.functions.text import normal_name_udf, stripped
from storyloom.operators.changes import without_chapters
from storyloom.operators.predicates import types_compatible
from storyloom.session import written

RESULT = """summary string,
entities array<struct<canonical_name string, type string, aliases_in_chapter array<string>, facts array<struct<fact string, snippet string>>>>,
events array<struct<story_time string, who string, what string, `where` string, why string, consequence string>>,
foreshadowing_new array<struct<hint string, snippet string>>,
foreshadowing_resolved array<struct<earlier_hint string, resolution string, snippet string>>,
rules array<struct<name string, body string, snippet string>>,
corrections array<struct<mention_id string, chapter_id string, correct_fact string, correct_snippet string, reason string>>"""
# Type of an entity whose type is not given, in whole and in partial results; reasons of revisions.
NO_TYPE, NO_TYPE_PARTIAL = "未分类", "人物"
GONE, CORRECTED = "重读后不再出现", "顺手校对: "
FIRST, AGAIN, MOST = (0.6, 1), (0.7, 2), 0.95

_NONE = "array<string>"


def parsed(results: DataFrame) -> DataFrame:
    """results (book_id, chapter_id, idx, result as JSON text) with the result as a struct; text that is no JSON object gives one without anything."""
    return results.withColumn("result", F.from_json("result", RESULT))


def _each(results: DataFrame, field: str, *columns: Column) -> DataFrame:
    rows = results.select("book_id", "chapter_id", "idx", F.posexplode(F.col("result")[field]).alias("place", "x"))
    return rows.select("book_id", "chapter_id", F.struct("idx", "chapter_id", "place").alias("at"), *columns)


def _filled(c: str) -> Column:
    return F.coalesce(stripped(F.col(c)), F.lit("")) != ""


def names_of(results: DataFrame, no_type: str = NO_TYPE) -> DataFrame:
    """(book_id, chapter_id, at, name, type, aliases, facts): every entity of every result; blank names are left out."""
    x = F.col("x")
    rows = _each(results, "entities", stripped(x["canonical_name"]).alias("name"), F.coalesce(F.nullif(x["type"], F.lit("")), F.lit(no_type)).alias("type"), x["aliases_in_chapter"].alias("aliases"), x["facts"].alias("facts"))
    return rows.where(_filled("name"))


def facts_of(names: DataFrame) -> DataFrame:
    """(book_id, chapter_id, name, fact, snippet, at, n): blank facts are left out."""
    rows = names.select("book_id", "chapter_id", "name", "at", F.posexplode("facts").alias("n", "f"))
    return rows.select("book_id", "chapter_id", "name", "at", "n", stripped(F.col("f.fact")).alias("fact"), F.col("f.snippet").alias("snippet")).where(_filled("fact"))


def _clean(aliases: Column, own: Column) -> Column:
    """Names of a list trimmed, once each, in order, without blanks and the own name."""
    trimmed = F.transform(F.coalesce(aliases, F.array().cast(_NONE)), lambda a: stripped(a))
    return F.array_distinct(F.filter(trimmed, lambda a: (F.coalesce(a, F.lit("")) != "") & ~a.eqNullSafe(own)))


def alias_rows(entities: DataFrame) -> DataFrame:
    """(book_id, entity_id, alias_norm, alias_raw): the name and the aliases of every entity, each spelling once."""
    raw = F.concat(F.array(stripped(F.col("canonical_name"))), _clean(F.col("aliases"), F.lit(None).cast("string")))
    rows = entities.select("book_id", F.col("id").alias("entity_id"), F.explode(raw).alias("alias_raw")).where("alias_raw <> ''").distinct()
    return rows.select("book_id", "entity_id", normal_name_udf("alias_raw").alias("alias_norm"), "alias_raw")


def resolved(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(book_id, name, entity_id, how, type, at, first_chapter_id, aliases) of every different name of a book in names_of().

    how: 'exact', the entity so called (the least id of several); 'alias', the first of (name, then its aliases in order) whose normal form an
    alias row of a type-compatible entity has; else 'new'. New names of one normal form and compatible types are one entity, called by the
    first of them; other names of entities that are new in a batch are known from the next batch on. Type and chapter are those where a name comes first.
    """
    own = names.withColumn("aliases", _clean(F.col("aliases"), F.col("name")))
    spelt = own.select("book_id", "name", "at", F.posexplode("aliases").alias("n", "a")).groupBy("book_id", "name", "a").agg(F.min(F.struct("at", "n")).alias("o"))
    lists = spelt.groupBy("book_id", "name").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "a"))), lambda s: s["a"]).alias("aliases"))
    first = own.groupBy("book_id", "name").agg(F.min(F.struct("at", "type", "chapter_id")).alias("f")).select("book_id", "name", "f.at", "f.type", F.col("f.chapter_id").alias("first_chapter_id"))
    wanted = first.join(lists, ["book_id", "name"], "left").withColumn("aliases", F.coalesce("aliases", F.array().cast(_NONE)))
    exact = entities.groupBy("book_id", F.col("canonical_name").alias("name")).agg(F.min("id").alias("exact_id"))
    step = written(wanted.join(exact, ["book_id", "name"], "left"), "names")  # read three times
    kinds = entities.select(F.col("id").alias("entity_id"), F.col("type").alias("other"))
    known = aliases.select("book_id", "entity_id", "alias_norm").distinct().join(kinds, "entity_id")
    checks = step.where("exact_id IS NULL").select("book_id", "name", "type", F.posexplode(F.concat(F.array("name"), "aliases")).alias("check", "said"))
    checks = written(checks.withColumn("alias_norm", normal_name_udf("said")), "checks")
    hits = checks.join(known, ["book_id", "alias_norm"]).where(types_compatible(F.col("type"), F.col("other")))
    by_alias = hits.groupBy("book_id", "name").agg(F.min(F.struct("check", "entity_id")).alias("h")).select("book_id", "name", F.col("h.entity_id").alias("alias_id"))
    step = step.join(by_alias, ["book_id", "name"], "left")
    step = written(step.withColumn("how", F.when(F.col("exact_id").isNotNull(), "exact").when(F.col("alias_id").isNotNull(), "alias").otherwise("new")), "steps")
    norm = checks.where("check = 0").select("book_id", "name", "alias_norm")
    fresh = step.where("how = 'new'").select("book_id", "name", "at", "type").join(norm, ["book_id", "name"])
    heads = fresh.groupBy("book_id", "alias_norm").agg(F.min(F.struct("at", "name", "type")).alias("h"))
    called = fresh.join(heads, ["book_id", "alias_norm"]).select("book_id", "name", F.when(types_compatible(F.col("type"), F.col("h.type")), F.col("h.name")).otherwise(F.col("name")).alias("called"))
    out = step.join(called, ["book_id", "name"], "left")
    return out.select("book_id", "name", F.coalesce("exact_id", "alias_id", new_id("entity", "book_id", "called")).alias("entity_id"), "how", "called", "type", "at", "first_chapter_id", "aliases")


def new_id(kind: str, *columns: str) -> Column:
    """The id of a record made from a result: the same whenever the same result is loaded."""
    return F.sha2(F.concat_ws("|", F.lit(kind), *columns), 256)


def entities_after(entities: DataFrame, found: DataFrame) -> DataFrame:
    """entities (id, book_id, canonical_name, type, aliases, first_chapter_id, name_norm) after resolved(): aliases joined, a missing first chapter and normal form filled in, new ones added."""
    spelt = found.where("how <> 'new'").select("entity_id", "at", F.posexplode("aliases").alias("n", "a")).groupBy("entity_id", "a").agg(F.min(F.struct("at", "n")).alias("o"))
    more = spelt.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "a"))), lambda s: s["a"]).alias("more"))
    chapter = found.where("how <> 'new'").groupBy("entity_id").agg(F.min(F.struct("at", "first_chapter_id")).alias("c"))
    joined = entities.join(more.withColumnRenamed("entity_id", "id"), "id", "left").join(chapter.withColumnRenamed("entity_id", "id"), "id", "left")
    none = F.array().cast(_NONE)
    old = joined.select(
        "id", "book_id", "canonical_name", "type", F.when(F.col("more").isNull(), F.coalesce("aliases", none)).otherwise(_clean(F.concat(F.coalesce("aliases", none), "more"), F.col("canonical_name"))).alias("aliases"),
        F.coalesce(F.nullif("first_chapter_id", F.lit("")), "c.first_chapter_id").alias("first_chapter_id"), F.coalesce(F.nullif("name_norm", F.lit("")), normal_name_udf("canonical_name")).alias("name_norm"),
    )
    fresh = found.where("how = 'new'").withColumn("own", F.explode(F.concat(F.array("name"), "aliases")))
    spelt = fresh.where("own <> called").groupBy("book_id", "called", "entity_id", "own").agg(F.min("at").alias("o"))
    lists = spelt.groupBy("entity_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "own"))), lambda s: s["own"]).alias("aliases"))
    heads = found.where("how = 'new' AND name = called").join(lists.withColumnRenamed("aliases", "listed"), "entity_id", "left")
    return old.unionByName(heads.select(F.col("entity_id").alias("id"), "book_id", F.col("called").alias("canonical_name"), "type", F.coalesce("listed", none).alias("aliases"), "first_chapter_id", normal_name_udf("called").alias("name_norm")))


def facts_diff(old: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(mentions, revisions) of chapters read again.

    old: mentions (id, entity_id, chapter_id, fact, snippet, created_at, confidence, pass_no); new: (entity_id, chapter_id, fact, snippet, at, n). Facts of a
    chapter match by their normal form; of old ones with one form the last (by created_at, id) counts. A fact found again gains 0.1 of confidence up to 0.95 and a pass,
    a new one has 0.7 and pass 2, one not found again becomes a superseded revision. An entity's fact is taken once.
    """
    last = old.withColumn("form", normal_name_udf("fact")).groupBy("chapter_id", "form").agg(F.max(F.struct("created_at", "id", "entity_id", "fact", "snippet", "confidence", "pass_no")).alias("o"))
    said = new.withColumn("form", normal_name_udf("fact")).groupBy("chapter_id", "entity_id", "form").agg(F.min(F.struct("at", "n", "fact", "snippet")).alias("s"))
    bumped = F.least(F.lit(MOST), F.coalesce("o.confidence", F.lit(FIRST[0])) + 0.1)
    mentions = said.join(last, ["chapter_id", "form"], "left").select(
        new_id("mention", "chapter_id", "entity_id", "form").alias("id"), "entity_id", "chapter_id", "s.fact", "s.snippet",
        F.when(F.col("o").isNull(), F.lit(AGAIN[0])).otherwise(bumped).alias("confidence"), F.when(F.col("o").isNull(), F.lit(AGAIN[1])).otherwise(F.coalesce("o.pass_no", F.lit(1)) + 1).alias("pass_no"),
    )
    lost = last.join(said.select("chapter_id", "form").distinct(), ["chapter_id", "form"], "left_anti")
    revisions = lost.select("o.entity_id", "chapter_id", "o.fact", "o.snippet", "o.confidence", "o.pass_no", F.lit("superseded").alias("status"), F.col("o.id").alias("supersedes"), F.lit(GONE).alias("reason"))
    return mentions, revisions


def rules_after(rules: DataFrame, mentions: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rules, rule mentions) with those of the results: a rule of a known name takes the body stated last and keeps its first chapter; a rule has one mention a chapter, its evidence replaced by the later one.

    Rules without a name or a body are left out; evidence is the snippet, else the first 200 characters of the body.
    """
    x = F.col("x")
    rows = _each(results, "rules", stripped(x["name"]).alias("name"), stripped(x["body"]).alias("body"), x["snippet"].alias("snippet")).where(_filled("name") & _filled("body"))
    stated = rows.groupBy("book_id", "name").agg(F.max(F.struct("at", "body")).alias("l"), F.min(F.struct("at", "chapter_id")).alias("f"))
    old = rules.select("id", "book_id", "name", F.col("body").alias("_body"), F.col("first_chapter_id").alias("_first"))
    both = old.join(stated, ["book_id", "name"], "full_outer")
    after = both.select(F.coalesce("id", new_id("rule", "book_id", "name")).alias("id"), "book_id", "name", F.coalesce("l.body", "_body").alias("body"), F.when(F.col("id").isNull(), F.col("f.chapter_id")).otherwise(F.col("_first")).alias("first_chapter_id"))
    evidence = F.coalesce(F.nullif("snippet", F.lit("")), F.left("body", F.lit(200)))
    seen = rows.join(after.select(F.col("id").alias("rule_id"), "book_id", "name"), ["book_id", "name"]).groupBy("rule_id", "chapter_id").agg(F.max(F.struct("at", evidence.alias("evidence"))).alias("e"))
    return after, rule_mentions_after(mentions, seen.select("rule_id", "chapter_id", F.col("e.evidence").alias("evidence")), after)


def rule_mentions_after(mentions: DataFrame, new: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule_id, chapter_id, evidence): mentions with new ones put in by (rule, chapter); evidence is replaced only if given; mentions of rules that are not there are refused."""
    a = mentions.groupBy("rule_id", "chapter_id").agg(F.min("evidence").alias("_old"))
    b = new.join(rules.select(F.col("id").alias("rule_id")), "rule_id", "left_semi").withColumnRenamed("evidence", "_new")
    return a.join(b, ["rule_id", "chapter_id"], "full_outer").select("rule_id", "chapter_id", F.coalesce(F.nullif("_new", F.lit("")), "_old").alias("evidence"))


def _events(results: DataFrame) -> DataFrame:
    x = F.col("x")
    rows = _each(results, "events", *(x[c].alias(c) for c in ("story_time", "who")), stripped(x["what"]).alias("what"), x["where"].alias("where_loc"), *(x[c].alias(c) for c in ("why", "consequence"))).where(_filled("what"))
    return rows.select(F.sha2(F.concat_ws("|", F.lit("event"), "chapter_id", F.col("at.place").cast("string")), 256).alias("id"), "book_id", "chapter_id", "story_time", "who", "what", "where_loc", "why", "consequence")


def _hints(results: DataFrame) -> DataFrame:
    rows = _each(results, "foreshadowing_new", stripped(F.col("x")["hint"]).alias("hint")).where(_filled("hint"))
    none = F.lit(None).cast("string")
    return rows.select(F.sha2(F.concat_ws("|", F.lit("hint"), "chapter_id", F.col("at.place").cast("string")), 256).alias("id"), "book_id", F.col("chapter_id").alias("hint_chapter_id"), "hint", F.lit("open").alias("status"), none.alias("resolved_chapter_id"), none.alias("resolution"))


def _settled(hints: DataFrame, results: DataFrame) -> DataFrame:
    """Open hints whose exact text a result of their book resolves; the first of several counts."""
    x = F.col("x")
    said = _each(results, "foreshadowing_resolved", stripped(x["earlier_hint"]).alias("hint"), x["resolution"].alias("resolution")).where(_filled("hint"))
    first = said.groupBy("book_id", "hint").agg(F.min(F.struct("at", "chapter_id", "resolution")).alias("r"))
    hit = F.col("r").isNotNull() & (F.col("status") == "open")
    new = {"status": F.lit("resolved"), "resolved_chapter_id": F.col("r.chapter_id"), "resolution": F.coalesce("r.resolution", F.lit(""))}
    return hints.join(first, ["book_id", "hint"], "left").withColumns({c: F.when(hit, v).otherwise(F.col(c)) for c, v in new.items()}).drop("r")


def _read(kb: dict[str, DataFrame], results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(results of chapters that were done, all others)."""
    done = kb["chapters"].where("status = 'done'").select(F.col("id").alias("chapter_id")).distinct()
    return results.join(done, "chapter_id", "left_semi"), results.join(done, "chapter_id", "left_anti")


def applied(kb: dict[str, DataFrame], results: DataFrame) -> dict[str, DataFrame]:
    """The tables of kb (chapters, entities, mentions, events, foreshadowing, rules, rule_mentions) after a batch of parsed results (book_id, chapter_id, idx, result), with
    the added rows of fact_revisions. results are read several times, so they should be a table."""
    return facts_applied(kb, results) | records_applied(kb, results)


def facts_applied(kb: dict[str, DataFrame], results: DataFrame) -> dict[str, DataFrame]:
    """entities, mentions and added fact_revisions of applied().

    Chapters that were done are compared, all others are loaded anew. Corrections in a repeated reading supersede the mention they name, of a chapter that the batch does not read, and where they
    state a fact, put it in its place with 0.7 and pass 2.
    """
    again, first = _read(kb, results)
    left = without_chapters({n: kb[n] for n in ("mentions", "events", "foreshadowing", "rules", "rule_mentions", "entities")}, first.select("chapter_id"))
    entities, names = written(left["entities"], "entities"), names_of(results)
    found = written(resolved(names, entities, alias_rows(entities)), "found")
    facts = written(facts_of(names).join(found.select("book_id", "name", "entity_id"), ["book_id", "name"]), "facts")
    ids = written(again.select("chapter_id").distinct(), "again")
    compared, revisions = facts_diff(left["mentions"].join(ids, "chapter_id", "left_semi"), facts.join(ids, "chapter_id", "left_semi"))
    added = facts.join(ids, "chapter_id", "left_anti").select(F.sha2(F.concat_ws("|", F.lit("mention"), "chapter_id", F.col("at.place").cast("string"), F.col("n").cast("string")), 256).alias("id"), "entity_id", "chapter_id", "fact", "snippet", F.lit(FIRST[0]).alias("confidence"), F.lit(FIRST[1]).alias("pass_no"))
    columns = ["id", "entity_id", "chapter_id", "fact", "snippet", "confidence", "pass_no"]
    kept = left["mentions"].join(ids, "chapter_id", "left_anti")
    x = F.col("x")
    said = _each(again, "corrections", *(x[c].alias(c) for c in ("mention_id", "correct_fact", "correct_snippet", "reason")), x["chapter_id"].alias("cid")).where(_filled("mention_id") & _filled("cid"))
    said = said.groupBy("book_id", "mention_id").agg(F.max(F.struct("at", "cid", "correct_fact", "correct_snippet", "reason")).alias("c"))
    own = kept.join(entities.select(F.col("id").alias("entity_id"), "book_id"), "entity_id").withColumnRenamed("id", "mention_id")
    wrong = written(own.join(said, ["book_id", "mention_id"]), "wrong")
    revisions = revisions.unionByName(wrong.select("entity_id", F.col("c.cid").alias("chapter_id"), "fact", "snippet", "confidence", "pass_no", F.lit("superseded").alias("status"), F.col("mention_id").alias("supersedes"), F.concat(F.lit(CORRECTED), F.coalesce("c.reason", F.lit(""))).alias("reason")))
    right = wrong.where(F.coalesce("c.correct_fact", F.lit("")) != "").select(new_id("correction", "mention_id").alias("id"), "entity_id", F.col("c.cid").alias("chapter_id"), F.col("c.correct_fact").alias("fact"), F.coalesce("c.correct_snippet", F.lit("")).alias("snippet"), F.lit(AGAIN[0]).alias("confidence"), F.lit(AGAIN[1]).alias("pass_no"))
    kept = kept.join(wrong.select(F.col("mention_id").alias("id")), "id", "left_anti")
    mentions = reduce(DataFrame.unionByName, [kept.select(columns), compared.select(columns), added.select(columns), right.select(columns)])
    return {"entities": entities_after(entities, found), "mentions": mentions, "fact_revisions": revisions}


def records_applied(kb: dict[str, DataFrame], results: DataFrame) -> dict[str, DataFrame]:
    """events, foreshadowing, rules and rule_mentions of applied(): what the chapters read held before is replaced."""
    again, first = _read(kb, results)
    left = without_chapters({n: kb[n] for n in ("mentions", "events", "foreshadowing", "rules", "rule_mentions", "entities")}, first.select("chapter_id"))
    drop = lambda df, column: df.join(again.select(F.col("chapter_id").alias(column)), column, "left_anti")
    rules = drop(left["rules"], "first_chapter_id")
    seen = left["rule_mentions"].join(rules.select(F.col("id").alias("rule_id")), "rule_id", "left_semi")
    rules, seen = rules_after(rules, seen, results)
    events, hints = _events(results), _hints(results)
    return {
        "events": drop(left["events"], "chapter_id").select(events.columns).unionByName(events),
        "foreshadowing": _settled(drop(left["foreshadowing"], "hint_chapter_id").select(hints.columns).unionByName(hints), results), "rules": rules, "rule_mentions": seen,
    }


def added_counts(results: DataFrame) -> DataFrame:
    """(chapter_id, kind, n): what a partial result adds to its chapter; hints planted and resolved count together."""
    x = F.col("x")
    kinds = {
        "mentions": facts_of(names_of(results, NO_TYPE_PARTIAL)), "events": _events(results),
        "foreshadowing": _each(results, "foreshadowing_new", x["hint"].alias("h")).where(_filled("h")).select("chapter_id").union(_each(results, "foreshadowing_resolved", x["earlier_hint"].alias("h")).where(_filled("h")).select("chapter_id")),
        "rules": _each(results, "rules", x["name"].alias("name"), x["body"].alias("body")).where(_filled("name") & _filled("body")),
    }
    return reduce(DataFrame.union, (rows.groupBy("chapter_id").agg(F.count("*").alias("n")).select("chapter_id", F.lit(k).alias("kind"), "n") for k, rows in kinds.items()))


def partially_applied(kb: dict[str, DataFrame], results: DataFrame) -> dict[str, DataFrame]:
    """kb (entities, mentions, events, foreshadowing, rules, rule_mentions) with what partial results add; nothing is removed."""
    names = names_of(results, NO_TYPE_PARTIAL)
    found = resolved(names, kb["entities"], alias_rows(kb["entities"]))
    facts = facts_of(names).join(found.select("book_id", "name", "entity_id"), ["book_id", "name"])
    columns = ["id", "entity_id", "chapter_id", "fact", "snippet", "confidence", "pass_no"]
    added = facts.select(F.sha2(F.concat_ws("|", F.lit("partial"), "chapter_id", F.col("at.place").cast("string"), F.col("n").cast("string")), 256).alias("id"), "entity_id", "chapter_id", "fact", "snippet", F.lit(FIRST[0]).alias("confidence"), F.lit(FIRST[1]).alias("pass_no"))
    rules, seen = rules_after(kb["rules"], kb["rule_mentions"], results)
    events, hints = _events(results), _hints(results)
    return {
        "entities": entities_after(kb["entities"], found), "mentions": kb["mentions"].select(columns).unionByName(added), "events": kb["events"].select(events.columns).unionByName(events),
        "foreshadowing": _settled(kb["foreshadowing"].select(hints.columns).unionByName(hints), results), "rules": rules, "rule_mentions": seen,
    }


def without_records(kb: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, counts): kb without the records in gone (book_id, kind, record_id) and all entities of those books that then have no mention.

    kinds are mentions (of entities of the book), events (with their layout and relations), foreshadowing and rules (with their mentions). counts (book_id, kind, n)
    holds the records removed by id; unknown ids and kinds count nothing.
    """
    gone = gone.where("record_id IS NOT NULL AND record_id <> ''").distinct()
    of = lambda kind: gone.where(F.col("kind") == kind).select("book_id", F.col("record_id").alias("id"))
    owned = kb["mentions"].join(kb["entities"].select(F.col("id").alias("entity_id"), "book_id"), "entity_id")
    hit = {"mentions": owned.join(of("mentions"), ["book_id", "id"], "left_semi").select("book_id", "id")}
    hit |= {k: kb[k].select("book_id", "id").join(of(k), ["book_id", "id"], "left_semi") for k in ("events", "foreshadowing", "rules")}
    left = {k: kb[k].join(h.select("id"), "id", "left_anti") for k, h in hit.items()}
    by = lambda k, name: hit[k].select(F.col("id").alias(name))
    left["rule_mentions"] = kb["rule_mentions"].join(by("rules", "rule_id"), "rule_id", "left_anti")
    if "timeline_event_meta" in kb:
        left["timeline_event_meta"] = kb["timeline_event_meta"].join(by("events", "event_id"), "event_id", "left_anti")
    if "timeline_relations" in kb:
        left["timeline_relations"] = kb["timeline_relations"].join(by("events", "source_event_id"), "source_event_id", "left_anti").join(by("events", "target_event_id"), "target_event_id", "left_anti")
    named = left["mentions"].select(F.col("entity_id").alias("id")).distinct()
    orphans = kb["entities"].join(gone.select("book_id").distinct(), "book_id", "left_semi").join(named, "id", "left_anti").select("id")
    left["entities"] = kb["entities"].join(orphans, "id", "left_anti")
    counts = reduce(DataFrame.union, (h.groupBy("book_id").agg(F.count("*").alias("n")).select("book_id", F.lit(k).alias("kind"), "n") for k, h in hit.items()))
    return left, counts


PATCH = f"`delete` struct<mentions array<string>, events array<string>, rules array<string>, foreshadowing array<string>>, `add` struct<{re.sub(r'(?m)^([a-z_]+) (?=string|array)', r'\1: ', RESULT)}>, note string"


def patched(kb: dict[str, DataFrame], patches: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables, counts) after patches (book_id, chapter_id, idx, patch as JSON text {delete: ids by kind, add: a result, note}) to what was misread.

    First all records named go, with entities left without a mention, then all results are added as partially_applied() does. counts: (book_id, kind, removed, added).
    A patch that is no JSON object changes nothing. What is to be embedded again follows from the tables (vectors.refreshed).
    """
    rows = written(patches.withColumn("p", F.from_json("patch", PATCH)).where("p IS NOT NULL").select("book_id", "chapter_id", "idx", "p"), "patches")
    kinds = ("mentions", "events", "rules", "foreshadowing")
    gone = reduce(DataFrame.union, (rows.select("book_id", F.lit(k).alias("kind"), F.explode(F.col("p.delete")[k]).alias("record_id")) for k in kinds))
    left, removed = without_records(kb, gone)
    results = rows.select("book_id", "chapter_id", "idx", F.col("p.add").alias("result"))
    after = partially_applied({**left, "rule_mentions": left["rule_mentions"]}, results)
    added = added_counts(results).join(rows.select("chapter_id", "book_id").distinct(), "chapter_id").groupBy("book_id", "kind").agg(F.sum("n").alias("added"))
    counts = removed.withColumnRenamed("n", "removed").join(added, ["book_id", "kind"], "full_outer")
    return after, counts.select("book_id", "kind", F.coalesce("removed", F.lit(0)).alias("removed"), F.coalesce("added", F.lit(0)).alias("added"))


def affected_sources(results: DataFrame) -> DataFrame:
    """(chapter_id, source_type, source): what a result touches: the summary, names, and events, hints and rules by their first 80 characters, each once."""
    x = F.col("x")
    short = lambda field, c, kind: _each(results, field, F.left(x[c], F.lit(80)).alias("source")).select("chapter_id", F.lit(kind).alias("source_type"), "source")
    parts = [
        results.select("chapter_id", F.lit("chapter_summary").alias("source_type"), F.lit("summary").alias("source")),
        _each(results, "entities", x["canonical_name"].alias("source")).select("chapter_id", F.lit("entity"), "source"),
        short("events", "what", "event"), short("foreshadowing_new", "hint", "foreshadowing"), _each(results, "rules", x["name"].alias("source")).select("chapter_id", F.lit("rule"), "source"),
    ]
    return reduce(DataFrame.union, parts).distinct()


def merges_recorded(entities: DataFrame, merges: DataFrame) -> DataFrame:
    """(book_id, from_name, into_id, reason): the record of every merge (from_id, into_id) of two entities of one book; others are refused."""
    a = entities.select(F.col("id").alias("from_id"), "book_id", F.col("canonical_name").alias("from_name"))
    b = entities.select(F.col("id").alias("into_id"), "book_id")
    return merges.where("from_id <> into_id").join(a, "from_id").join(b, ["into_id", "book_id"]).select("book_id", "from_name", "into_id", F.lit("manual").alias("reason"))


def backfilled(entities: DataFrame, mentions: DataFrame) -> DataFrame:
    """entities with missing normal forms filled in and mention_cnt counted."""
    counts = mentions.groupBy(F.col("entity_id").alias("id")).agg(F.count("*").alias("_n"))
    norm = F.coalesce(F.nullif("name_norm", F.lit("")), normal_name_udf("canonical_name"))
    return entities.join(counts, "id", "left").withColumns({"name_norm": norm, "mention_cnt": F.coalesce("_n", F.lit(0))}).drop("_n")
