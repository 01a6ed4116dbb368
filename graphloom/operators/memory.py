"""Transcripts: sentences, classes, entities, dedup, answered questions, budgets, briefings.

Everything works on all conversations at once; a conversation is only ever a window or
join key, with the turn or position as the explicit order.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.functions.identifiers import estimated_tokens
from graphloom.functions.predicates import STOP_WORDS
from graphloom.sources.artifacts import read_sections

# Cues of the classes, compared in lower case.
LEXICON: dict[str, tuple[str, ...]] = {
    "decision": ("decided to", "let's go with", "we'll use", "the plan is", "decision:", "agreed to", "will use", "going with",
                 "chosen approach", "i'll implement", "the approach is", "recommendation:", "recommend:"),
    "assistant_decision": ("we should",),
    "error": ("error:", "failed", "exception", "traceback", "bug", "broken", "doesn't work", "does not work", "issue:", "problem:", "crash", "stack trace"),
    "conclusion": ("turns out", "learned that", "the reason", "the root cause", "conclusion", "in summary", "key insight", "important:", "note:",
                   "found that", "discovered", "works because"),
    "change_verb": ("changed", "modified", "added", "removed", "refactored", "updated", "renamed", "created", "implemented", "wrote", "fixed the", "patched"),
    "change_noun": ("function", "class", "method", "file", "module", "test", "config", "api", "endpoint", "handler", "component", "import", "`",
                    "section", "doc", "documentation", "spec", "format", "guide", "readme", "schema", "template", "hook", "route", "middleware",
                    "model", "migration", "script", "command", "prompt", "pipeline", "workflow"),
    "question": ("?", "not sure", "unclear", "need to figure out", "todo", "investigate", "might need", "open question", "still need to",
                 "haven't decided", "tbd", "worth considering"),
    "weak_conclusion": ("because", "confirmed", "verified"),
}
# What is an entity, and whether once is enough.
ENTITY_PATTERNS: tuple[tuple[str, str, bool], ...] = (
    ("quoted", r"`([^`]{2,60})`", True),
    ("phrase", r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+)+)\b", False),
    ("file", r"\b([\w.-]+\.(?:py|md|json|js|ts|yaml|yml|toml|cfg|txt|html|css|sh|go|rs))\b", True),
    ("snake", r"\b([a-z]+(?:_[a-z]+){1,5})\b", False),
    ("camel", r"\b([a-z]+[A-Z][a-zA-Z]+)\b", False),
)
# The order in which classes fill the budget.
PRIORITY = ("decision", "error", "conclusion", "code_change", "open_question")


def sentences(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, at, sentence): texts split after . ! or ? and white space."""
    split = messages.select("conv_id", "turn", "role", F.posexplode(F.split("text", r"(?<=[.!?])\s+")).alias("at", "raw"))
    return split.select("conv_id", "turn", "role", "at", F.trim("raw").alias("sentence")).filter("sentence <> ''")


def classify(rows: DataFrame, lexicon: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """``rows`` of :func:`sentences` with category and confidence; sentences of no class go."""
    cues = LEXICON | (lexicon or {})
    low = F.lower("sentence")
    has = lambda kind: reduce(lambda a, b: a | b, [F.contains(low, F.lit(c)) for c in cues[kind]], F.lit(False))
    asks = F.col("sentence").endswith("?")
    found = (
        F.when(~asks & has("decision"), F.struct(F.lit("decision"), F.lit(0.9)))
        .when(~asks & has("assistant_decision") & (F.col("role") == "assistant"), F.struct(F.lit("decision"), F.lit(0.85)))
        .when(has("error"), F.struct(F.lit("error"), F.lit(0.85)))
        .when(has("conclusion"), F.struct(F.lit("conclusion"), F.lit(0.8)))
        .when(~asks & has("change_verb") & has("change_noun"), F.struct(F.lit("code_change"), F.lit(0.85)))
        .when(has("question"), F.struct(F.lit("open_question"), F.lit(0.6)))
        .when(has("weak_conclusion"), F.struct(F.lit("conclusion"), F.lit(0.8)))
    )
    return rows.withColumn("found", found).filter("found is not null").select("conv_id", "turn", "role", "at", "sentence", F.col("found.col1").alias("category"), F.col("found.col2").alias("confidence"))


def entities(messages: DataFrame, patterns: tuple[tuple[str, str, bool], ...] = ENTITY_PATTERNS) -> DataFrame:
    """(conv_id, entity, n): entities met twice, or once where the pattern allows it."""
    each = reduce(DataFrame.unionAll, [
        messages.select("conv_id", F.explode(F.regexp_extract_all("text", F.lit(p), F.lit(1))).alias("entity"), F.lit(once).alias("once"), F.lit(kind).alias("kind"))
        for kind, p, once in patterns])
    each = each.filter((F.col("kind") != "snake") | (F.length("entity") > 5))
    return each.groupBy("conv_id", "entity").agg(F.count("*").alias("n"), F.max("once").alias("once")).filter("n >= 2 or once").select("conv_id", "entity", "n")


def entity_dictionary(found: DataFrame, messages: DataFrame) -> DataFrame:
    """(conv_id, entity, symbol): the most frequent entities of each conversation, as many as its length allows."""
    sizes = messages.groupBy("conv_id").agg(F.count("*").alias("messages"))
    order = Window.partitionBy("conv_id").orderBy(F.desc("n"), "entity")
    top = found.join(sizes, "conv_id").withColumn("place", F.row_number().over(order))
    top = top.filter(F.col("place") <= F.least(F.lit(50), F.greatest(F.lit(8), 2 * F.col("messages"))))
    short = F.concat(F.lit("s_"), F.substring(F.sha2(F.lower("entity"), 256), 1, 6))
    clash = F.row_number().over(Window.partitionBy("conv_id", short).orderBy("place")) > 1
    return top.select("conv_id", "entity", F.when(clash, F.concat(F.lit("s_"), F.substring(F.sha2("entity", 256), 1, 8))).otherwise(short).alias("symbol"))


def with_symbols(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """``entries`` with refs, and the entities in their sentence replaced, longest first."""
    lists = dictionary.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct((-F.length("entity")).alias("order"), "entity", "symbol"))).alias("words"))
    joined = entries.join(lists, "conv_id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<order:int,entity:string,symbol:string>>")))
    present = F.filter("words", lambda w: F.contains(F.col("sentence"), w["entity"]))
    replaced = F.aggregate("words", F.col("sentence"), lambda s, w: F.replace(s, w["entity"], w["symbol"]))
    marked = joined.withColumn("refs", F.transform(present, lambda w: w["symbol"]))
    return marked.withColumn("sentence", replaced).select("conv_id", "turn", "role", "at", "sentence", "category", "confidence", "refs")


def dedup_key(text: Column) -> Column:
    return F.substring(F.trim(_words_only(text)), 1, 80)


def _words_only(text: Column) -> Column:
    """Lower-cased, with letters and digits of any script, ``_`` and white space only."""
    return F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")


def dedup(entries: DataFrame) -> DataFrame:
    """One entry per conversation and key: the most confident, else the first; it takes the first one's place."""
    same = Window.partitionBy("conv_id", "key")
    best = same.orderBy(F.desc("confidence"), "turn", "at")
    placed = entries.withColumn("key", dedup_key(F.col("sentence")))
    placed = placed.withColumn("place", F.row_number().over(best)).withColumn("first", F.min(F.struct("turn", "at")).over(same))
    return placed.filter("place = 1").drop("key", "place")


def question_words(text: Column) -> Column:
    words = F.split(F.trim(_words_only(text)), r"(?U)\s+")
    return F.array_distinct(F.filter(words, lambda w: (w != "") & ~w.isin(*STOP_WORDS)))


def open_questions(entries: DataFrame) -> DataFrame:
    """``entries`` without the questions that a later decision or conclusion answers in enough of their words.

    Joined on the words (questions and answers exploded), so only pairs that share one meet.
    """
    asked = entries.filter("category = 'open_question'").select("conv_id", "turn", "at", question_words(F.col("sentence")).alias("words")).filter(F.size("words") >= 2)
    answers = entries.filter("category in ('decision', 'conclusion')").select("conv_id", F.col("turn").alias("later"), F.col("at").alias("later_at"), F.explode(question_words(F.col("sentence"))).alias("word"))
    each = asked.select("conv_id", "turn", "at", F.size("words").alias("n"), F.explode("words").alias("word"))
    shared = each.join(answers, ["conv_id", "word"]).filter("later > turn").groupBy("conv_id", "turn", "at", "n", "later", "later_at").agg(F.count("*").alias("both"))
    answered = shared.filter(F.col("both") >= F.greatest(F.lit(2), F.floor(F.col("n") * 0.4))).select("conv_id", "turn", "at").distinct().withColumn("category", F.lit("open_question"))
    return entries.join(answered, ["conv_id", "turn", "at", "category"], "left_anti")


def within_budget(entries: DataFrame, messages: DataFrame, most: int = 15, least: int = 5) -> DataFrame:
    """One entry of each class first, then by class and confidence, up to a number that follows the conversation's length.

    Equals stand in the order of ``first``, the place of a sentence's first occurrence (of
    :func:`dedup`).  Only the first ``most`` of a class can be among the chosen, so these
    are picked before a conversation's classes come together.
    """
    rank = F.array_position(F.array(*map(F.lit, PRIORITY)), F.col("category"))
    placed = entries if "first" in entries.columns else entries.withColumn("first", F.struct("turn", "at"))
    order = [F.desc("confidence"), "first"]
    placed = placed.withColumn("own", F.row_number().over(Window.partitionBy("conv_id", "category").orderBy(*order))).filter(F.col("own") <= most)
    sizes = messages.groupBy("conv_id").agg(F.count("*").alias("messages"))
    placed = placed.join(sizes, "conv_id").withColumn("reserved", F.col("own") == 1)
    placed = placed.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("reserved"), rank, *order)))
    budget = F.least(F.lit(most), F.greatest(F.lit(least), F.col("messages")))
    return placed.filter(F.col("reserved") | (F.col("place") <= budget)).drop("messages", "reserved", "own")


def shortened(text: Column) -> Column:
    return F.when(F.length(text) > 150, F.concat(F.substring(text, 1, 147), F.lit("..."))).otherwise(text)


# How an assistant tells what it is about, tried in this order.
TASK_PATTERNS = (
    r"(?i)(?:I'll|Let me|I will|I can see|Here's the plan)[^.]*\.",
    r"(?i)(?:The (?:task|issue|problem|goal) is)[^.]*\.",
    r"(?i)(?:Working on|Looking at)[^.]*\.",
)


def context_summary(messages: DataFrame, short: int = 30) -> DataFrame:
    """(conv_id, summary): the first user text's first sentence, or a longer of the next two if that is short;
    if it still is, a longer phrase of an assistant among the first four messages."""
    text = F.trim("text")
    dot = F.instr(text, ". ")
    cut = F.when((dot > 1) & (dot <= 200), F.substring(text, F.lit(1), dot)).otherwise(F.substring(text, 1, 200))
    user = messages.filter("role = 'user'").filter(text != "").select("conv_id", "turn", cut.alias("cut"))
    user = user.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("place <= 3")
    in_order = lambda key, value: F.transform(F.sort_array(F.collect_list(F.struct(key, value))), lambda x: x[value])
    lists = user.groupBy("conv_id").agg(in_order("place", "cut").alias("cuts"))
    begun = messages.withColumn("place", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))).filter("place <= 4 and role = 'assistant'")
    phrases = F.array(*[F.regexp_extract(text, p, 0) for p in TASK_PATTERNS])
    told = begun.select("conv_id", "place", phrases.alias("phrases")).groupBy("conv_id").agg(in_order("place", "phrases").alias("told"))
    longer = lambda best, c: F.when(F.length(c) > F.length(best), c).otherwise(best)
    first = F.get("cuts", F.lit(0))
    best = F.when(F.length(first) < short, F.aggregate("cuts", first, longer)).otherwise(first)
    # of a message the first phrase that is longer than what there is, cut to 200
    in_message = lambda best, phrases: F.coalesce(F.substring(F.get(F.filter(phrases, lambda p: F.length(p) > F.length(best)), F.lit(0)), 1, 200), best)
    best = F.when(F.length(best) < short, F.aggregate(F.coalesce("told", F.array().cast("array<array<string>>")), best, in_message)).otherwise(best)
    every = messages.select("conv_id").distinct()
    return every.join(lists, "conv_id", "left").join(told, "conv_id", "left").select("conv_id", F.coalesce(F.concat(F.lit("Task: "), best), F.lit("No context available.")).alias("summary"))


def compress(messages: DataFrame, lexicon: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """The whole chain: entries (conv_id, place, category, sentence, confidence, refs) within budget."""
    entries = classify(sentences(messages), lexicon)
    entries = with_symbols(entries, entity_dictionary(entities(messages), messages))
    kept = within_budget(open_questions(dedup(entries)), messages)
    return kept.select("conv_id", "place", "category", shortened(F.col("sentence")).alias("sentence"), "confidence", "refs")


def stats(messages: DataFrame) -> DataFrame:
    """(conv_id, messages, tokens): tokens estimated on the joined text."""
    joined = messages.groupBy("conv_id").agg(F.count("*").alias("messages"), (F.sum(F.length("text")) + F.count("*") - 1).alias("chars"))
    return joined.select("conv_id", "messages", F.greatest(F.lit(1), F.floor(F.col("chars") / 4)).cast("long").alias("tokens"))


def by_category(entries: DataFrame) -> DataFrame:
    return entries.groupBy("conv_id", "category").agg(F.sort_array(F.collect_list(F.struct("turn", "at", "sentence"))).alias("items"))


def decompress(entries: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Sentences with the entities back in place of their symbols and without marks."""
    lists = dictionary.groupBy("conv_id").agg(F.collect_list(F.struct("entity", "symbol")).alias("words"))
    joined = entries.join(lists, "conv_id", "left").withColumn("words", F.coalesce("words", F.array().cast("array<struct<entity:string,symbol:string>>")))
    plain = F.trim(F.regexp_replace(F.regexp_replace("sentence", r"\s*refs=\S+", ""), r"\s*\[[0-9]+\.[0-9]+\]", ""))
    return joined.withColumn("sentence", F.aggregate("words", plain, lambda s, w: F.replace(s, w["symbol"], w["entity"]))).drop("words")


def latest_memory(memories: DataFrame) -> DataFrame:
    """The conversation that was appended last, of rows (seq, conv_id, ...)."""
    return memories.join(F.broadcast(memories.agg(F.max_by("conv_id", "seq").alias("conv_id"))), "conv_id", "left_semi")


def append_memory(entries: DataFrame, path: str, seq: int) -> None:
    """Add a conversation's entries to the memories under ``path``; ``seq`` tells their order."""
    entries.withColumn("seq", F.lit(seq).cast("long")).write.mode("append").parquet(path)


def briefing(inferences: DataFrame, flags: DataFrame, patches: DataFrame, entries: DataFrame, dictionary: DataFrame | None = None, top: int = 10) -> DataFrame:
    """(section, place, text): the surest inferences, all flags (with a mark if verified), pending patches, and what the
    last appended memory (``entries`` with seq) decided or learned, with its entities spelled out."""
    best = inferences.orderBy(F.desc("confidence"), "seq").limit(top)
    line = F.concat_ws(" ", "target", F.concat(F.lit("["), F.col("confidence").cast("string"), F.lit("]")), "text") if "target" in inferences.columns else F.col("text")
    sections = [best.select(F.lit("inferences").alias("section"), (F.row_number().over(Window.orderBy(F.desc("confidence"), "seq"))).alias("place"), line.alias("text"))]
    flag = F.concat_ws(" ", *[c for c in ("target",) if c in flags.columns], "text")
    sections.append(flags.select(F.lit("flags"), F.lit(0), F.when(F.col("verified"), F.concat(flag, F.lit(" [VERIFIED]"))).otherwise(flag)))
    patch = F.concat_ws(" ", *[c for c in ("patch_id", "target") if c in patches.columns], "text")
    sections.append(patches.filter("status = 'pending'").select(F.lit("patches"), F.lit(0), patch))
    latest = latest_memory(entries)
    latest = decompress(latest, dictionary) if dictionary is not None else latest
    for section, category in (("decisions", "decision"), ("learned", "conclusion")):
        sections.append(latest.filter(F.col("category") == category).select(F.lit(section), F.col("place").cast("int") if "place" in latest.columns else F.lit(0), "sentence"))
    return reduce(DataFrame.unionAll, sections)


#: Sections of a briefing in the order in which they are told, and their headings.
HEADINGS = {"inferences": "Prior inferences, by confidence", "flags": "Flags", "patches": "Pending patches", "decisions": "Decisions", "learned": "Learned",
            "code_changes": "Code changes", "errors": "Errors", "open_questions": "Open questions"}


def prompt(sections: DataFrame) -> DataFrame:
    """The briefing as Markdown, one row a section, in order."""
    order = F.array_position(F.array(*map(F.lit, HEADINGS)), F.col("section"))
    title = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in HEADINGS.items() for x in pair]), F.col("section")), F.col("section"))
    rows = sections.withColumn("place", F.col("place") if "place" in sections.columns else F.lit(0))
    items = F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda t: F.concat(F.lit("- "), t["text"]))
    return rows.groupBy("section").agg(items.alias("items")).select(
        order.alias("place"), "section", F.concat(F.lit("### "), title, F.lit("\n"), F.array_join("items", "\n"), F.lit("\n")).alias("markdown")).orderBy("place")


#: The sections of the text form of a memory, in order, and the class that each holds.
MEMORY_SECTIONS = {"DECISIONS": "decision", "CONCLUSIONS": "conclusion", "OPEN_QUESTIONS": "open_question", "CODE_CHANGES": "code_change", "ERRORS": "error"}


def memory_text(entries: DataFrame, dictionary: DataFrame, summaries: DataFrame, counts: DataFrame) -> DataFrame:
    """(conv_id, text): each conversation's memory as text, in sections between ``[NAME]`` and ``[/NAME]``.

    Entries are (conv_id, place, category, sentence, confidence, refs), counts those of
    :func:`stats`.  An entry's line ends with its confidence and the ids it refers to.
    """
    block = lambda name, body: F.concat(F.lit(f"[{name}]\n"), body, F.lit(f"\n[/{name}]\n"))
    tail = F.when(F.size("refs") > 0, F.concat(F.lit(" refs="), F.array_join("refs", ","))).otherwise(F.lit(""))
    line = F.concat("sentence", F.lit(" ["), F.format_number("confidence", 1), F.lit("]"), tail)
    rows = entries.withColumn("line", line).groupBy("conv_id").agg(*[
        F.transform(F.sort_array(F.collect_list(F.when(F.col("category") == kind, F.struct("place", "line")))), lambda x: x["line"]).alias(name) for name, kind in MEMORY_SECTIONS.items()])
    names = dictionary.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.concat_ws("=", "symbol", "entity"))).alias("DICT"))
    joined = summaries.join(counts, "conv_id", "left").join(names, "conv_id", "left").join(rows, "conv_id", "left")
    parts = [F.lit("[MEMORY:1.0]\n"), block("STATS", F.concat(F.lit("messages="), "messages", F.lit("\noriginal_tokens="), "tokens")), block("CONTEXT", F.col("summary"))]
    parts += [F.when(F.size(name) > 0, block(name, F.array_join(name, "\n"))) for name in ("DICT", *MEMORY_SECTIONS)]
    return joined.select("conv_id", F.concat_ws("", *parts).alias("text"))


def read_memory(texts: DataFrame) -> dict[str, DataFrame]:
    """The inverse of :func:`memory_text`: summaries, dictionary, counts and entries of texts (conv_id, text)."""
    rows = read_sections(texts.select(F.col("conv_id").alias("artifact"), "text")).withColumnRenamed("artifact", "conv_id")
    rows = rows.filter(~F.col("line").startswith("[/"))
    lines = lambda name: rows.filter(F.col("section") == name)
    stat = lambda name: F.max(F.regexp_extract("line", f"^{name}=([0-9]+)$", 1).try_cast("long")).alias(name)
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in MEMORY_SECTIONS.items() for x in pair]), F.col("section"))
    entries = rows.filter(F.col("section").isin(*MEMORY_SECTIONS)).select("conv_id", F.col("at").alias("place"), kind.alias("category"), "line")
    refs = F.regexp_extract("line", r" refs=(\S+)$", 1)
    return {
        "summaries": lines("CONTEXT").groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n").alias("summary")),
        "counts": lines("STATS").groupBy("conv_id").agg(stat("messages"), stat("original_tokens")),
        "dictionary": lines("DICT").select("conv_id", F.regexp_extract("line", "^[^=]*=(.*)$", 1).alias("entity"), F.regexp_extract("line", "^([^=]*)=", 1).alias("symbol")),
        "entries": entries.select(
            "conv_id", "place", "category", F.trim(F.regexp_replace(F.regexp_replace("line", r" refs=\S+$", ""), r"\s*\[[0-9]+\.[0-9]+\]$", "")).alias("sentence"),
            F.coalesce(F.regexp_extract("line", r"\[([0-9]+\.[0-9]+)\]", 1).try_cast("double"), F.lit(0.8)).alias("confidence"), F.filter(F.split(refs, ","), lambda r: r != "").alias("refs")),
    }


def briefing_text(sections: DataFrame, summary: str = "") -> DataFrame:
    """(text): a briefing's sections between ``[NAME]`` and ``[/NAME]``, one row."""
    names = [n for n in HEADINGS]
    rows = sections.withColumn("place", F.col("place") if "place" in sections.columns else F.lit(0))
    lists = rows.groupBy("section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "text"))), lambda x: x["text"]), "\n").alias("body"))
    order = F.array_position(F.array(*map(F.lit, names)), F.col("section"))
    blocks = lists.select(order.alias("place"), F.concat(F.lit("["), F.upper("section"), F.lit("]\n"), "body", F.lit("\n[/"), F.upper("section"), F.lit("]\n")).alias("block"))
    context = f"[CONTEXT]\n{summary}\n[/CONTEXT]\n" if summary else ""
    return blocks.agg(F.concat(F.lit("[RESUME:1.0]\n" + context), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "block"))), lambda x: x["block"]), "")).alias("text"))


def read_briefing(texts: DataFrame) -> DataFrame:
    """(section, place, text, verified) of a briefing's text (artifact, text)."""
    rows = read_sections(texts).filter(~F.col("line").startswith("[/"))
    marked = F.col("line").endswith(" [VERIFIED]")
    return rows.select(F.lower("section").alias("section"), F.col("at").alias("place"), F.regexp_replace("line", r" \[VERIFIED\]$", "").alias("text"), (marked & (F.col("section") == "FLAGS")).alias("verified"))


def entry_tokens(entries: DataFrame) -> DataFrame:
    return entries.groupBy("conv_id").agg(F.sum(estimated_tokens(F.col("sentence"))).alias("tokens"))


def fidelity(facts: DataFrame, sections: DataFrame, enough: float = 0.4) -> DataFrame:
    """(category, found, facts): the share of facts (category, key, value) that a briefing (section, key, text) keeps.

    Inferences, flags and patches are looked up by their key, and enough of the fact's words
    must be there; decisions and conclusions must be part of what was decided or learned.
    """
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    told = sections.filter(F.col("section").isin("decisions", "learned")).agg(F.lower(F.array_join(F.collect_list("text"), " ")).alias("told"))
    kept = sections.filter(F.col("section").isin("inferences", "flags", "patches")).select(F.regexp_replace("section", "(e?)s$", "$1").alias("category"), "key", F.col("text").alias("kept"))
    kept = kept.withColumn("category", F.when(F.col("category") == "patche", "patch").otherwise(F.col("category")))
    kept = kept.groupBy("category", "key").agg(F.first("kept").alias("kept"))
    both = F.size(F.array_intersect(words("value"), words(F.coalesce("kept", F.lit("")))))
    overlap = (F.size(words("value")) == 0) | (both >= F.greatest(F.lit(1.0), F.size(words("value")) * enough))
    found = F.when(F.col("category").isin("decision", "conclusion"), F.contains(F.coalesce("told", F.lit("")), F.lower("value"))).otherwise(F.col("kept").isNotNull() & overlap)
    rows = facts.join(kept, ["category", "key"], "left").crossJoin(F.broadcast(told))
    return rows.groupBy("category").agg(F.avg(found.cast("int")).alias("found"), F.count("*").alias("facts"))
