"""From source text to nodes, edges and units.

Every extractor takes files (source_file, text, codebase_id) and gives nodes (id, type, name,
codebase_id, content_hash, parse_confidence, properties, source_file), edges (src, dst, type,
properties) and units (kind, name, source, content_hash, node_id, source_file, codebase_id).  The work
is done by built-in text functions on whole files, so it stays in the JVM.  Each kind of source is read
once: one pass turns every file into arrays of what it holds (paragraphs, fields, steps, tables, ...),
which is written to the checkpoint folder; nodes, edges and units are small explodes of that.  Statements
are taken apart into their words, and clauses are found by the word that begins them.  Nothing is
shuffled except where rows of one id are merged.

What reads oddly is kept with lower confidence and an anomaly, never dropped.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orefield.functions.model import node_id, properties
from orefield.functions.text import content_area, content_hash, lines, replace_pairs, squeeze, token_estimate, without_literals
from orefield.plans.lineage import cut
from orefield.sources.files import of_kind, stem

NODE = ("id", "type", "name", "codebase_id", "content_hash", "parse_confidence", "properties", "source_file")


@dataclass(frozen=True)
class Extract:
    nodes: DataFrame
    edges: DataFrame
    units: DataFrame


def _all(text: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def _node(kind: str, name: Column, hash_: Column | None = None, confidence: Column | float = 1.0, props: Column | None = None) -> list[Column]:
    c = F.lit(confidence) if isinstance(confidence, (int, float)) else confidence
    return [
        node_id(kind, F.col("codebase_id"), name).alias("id"), F.lit(kind).alias("type"), name.alias("name"), "codebase_id",
        (F.lit("") if hash_ is None else hash_).alias("content_hash"), c.cast("double").alias("parse_confidence"), (F.lit("{}") if props is None else props).alias("properties"), "source_file",
    ]


def _edge(src: Column, dst: Column, kind: str | Column, props: Column | None = None) -> list[Column]:
    return [src.alias("src"), dst.alias("dst"), (F.lit(kind) if isinstance(kind, str) else kind).alias("type"), (F.lit("{}") if props is None else props).alias("properties")]


def _unit(kind: str, name: Column, source: Column, id_: Column) -> list[Column]:
    return [F.lit(kind).alias("kind"), name.alias("name"), source.alias("source"), content_hash(source).alias("content_hash"), id_.alias("node_id"), "source_file", "codebase_id"]


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _cb(name: Column, kind: str) -> Column:
    return node_id(kind, F.col("codebase_id"), name)


def _after(words: Column, *keys: str, skip: str = "") -> Column:
    """The word behind the first occurrence of any of the keys (and behind ``skip``, if that stands there); null if there is none."""
    out = F.lit(None).cast("string")
    for key in reversed(keys):
        at = F.array_position(words, key).cast("int")
        word = F.get(words, at)
        if skip:
            word = F.when(word == skip, F.get(words, at + 1)).otherwise(word)
        out = F.when(at > 0, word).otherwise(out)
    return out


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often it is used within."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _pairs(words: Column) -> Column:
    """Every word with the one before it and the one before that."""
    return _let(words, lambda ws: F.transform(ws, lambda w, i: F.struct(F.get(ws, i - 2).alias("first"), F.get(ws, i - 1).alias("before"), w.alias("word"))))


def _none(text: Column) -> Column:
    return F.when(text != "", text)


# ---------------------------------------------------------------- COBOL

#: The statements of the language, and the words of clauses that may stand alone on a line; neither names a paragraph.
STATEMENTS = (
    "ACCEPT ADD ALLOCATE ALTER CALL CANCEL CLOSE COMPUTE CONTINUE COPY DELETE DISPLAY DIVIDE ENTRY EVALUATE EXEC EXECUTE EXIT FREE GENERATE GO GOBACK IF INITIALIZE INITIATE INSPECT INVOKE JSON MERGE MOVE MULTIPLY "
    "OPEN PERFORM RAISE READ RELEASE RESUME RETURN REWRITE SEARCH SET SORT START STOP STRING SUBTRACT SUPPRESS TERMINATE UNLOCK UNSTRING USE VALIDATE WRITE XML"
).split()
CLAUSES = "AND ELSE NOT OR THEN THROUGH THRU TO UNTIL VARYING WHEN".split()
NO_PARAGRAPH = "|".join([*STATEMENTS, *CLAUSES, "END-[A-Z]+"])
_HEADER = rf"(?!(?:{NO_PARAGRAPH})[ \t]*\.)[A-Z0-9][A-Z0-9-]*[ \t]*\.[ \t]*$"
_PERFORMED = r"(?i)\bPERFORM\s+(?!UNTIL\b|VARYING\b|WITH\b|TEST\b|\d+\s+TIMES\b)([A-Z0-9-]+(?:\s+(?:THRU|THROUGH)\s+[A-Z0-9-]+)?)"


def programs(files: DataFrame) -> DataFrame:
    """COBOL files with their code area, program name, includes and SQL blocks."""
    area = F.array_join(F.transform(lines(F.col("text")), content_area), "\n")
    f = of_kind(files, "cobol").select("source_file", "codebase_id", area.alias("code"))
    f = f.withColumn("bare", without_literals(F.col("code")))
    named = F.upper(F.regexp_extract("code", r"(?i)PROGRAM-ID\.\s*([A-Z0-9-]+)", 1))
    copies = F.transform(_all(F.col("bare"), r"(?i)\bCOPY\s+([A-Z0-9-]+(?:\s+REPLACING\s+.+?)?)\s*\."), lambda c: F.struct(
        F.upper(F.regexp_extract(c, r"^([A-Za-z0-9-]+)", 1)).alias("copybook"),
        F.transform(F.regexp_extract_all(c, F.lit(r"(?i)==[A-Z0-9-]+==\s+BY\s+==[A-Z0-9-]+=="), F.lit(0)), lambda p: F.struct(
            F.upper(F.regexp_extract(p, r"^==([A-Za-z0-9-]+)==", 1)).alias("from"), F.upper(F.regexp_extract(p, r"==([A-Za-z0-9-]+)==$", 1)).alias("to"))).alias("pairs"),
    ))
    return f.select(
        "source_file", "codebase_id", "code", "bare", F.when(named != "", named).otherwise(F.upper(stem(F.col("source_file")))).alias("program"), copies.alias("copies"),
        _all(F.col("bare"), r"(?is)\bEXEC\s+SQL\b(.*?)END-EXEC").alias("sql"),
        F.regexp_extract("code", r"(?is)\bPROCEDURE\s+DIVISION[^\n]*\n(.*)", 1).alias("procedure"),
    )


def _sections(procedure: Column) -> Column:
    """(paragraph, body, lead) of a procedure division; code before the first header belongs to the first paragraph, or to MAIN if there is none."""
    # The line feed before keeps what precedes the first header a part of its own, if only an empty one.
    return _let(F.split(F.concat(F.lit("\n"), procedure), rf"(?m)^(?=[ \t]{{0,3}}{_HEADER})", -1), _sections_of)


def _sections_of(parts: Column) -> Column:
    lead = F.trim(F.get(parts, F.lit(0)))
    acts = lead.rlike(r"(?i)\b(PERFORM|CALL)\b")
    chosen = F.when((F.size(parts) == 1) & acts, F.array(F.concat(F.lit("MAIN.\n"), lead))).otherwise(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))))
    content = F.transform(chosen, lambda part: F.filter(F.transform(F.split(part, "\n"), lambda x: F.trim(x)), lambda x: x != ""))
    first = F.when((F.size(parts) > 1) & acts, lead).otherwise("")
    return F.transform(content, lambda c, i: F.struct(
        F.upper(F.regexp_extract(F.get(c, F.lit(0)), r"^([A-Za-z0-9-]+)", 1)).alias("paragraph"),
        F.array_join(F.slice(c, 2, F.greatest(F.size(c) - 1, F.lit(0))), "\n").alias("body"), F.when(i == 0, first).otherwise("").alias("lead"),
    ))


def _paragraph_rows(rows: DataFrame) -> DataFrame:
    """One row per paragraph of (source_file, codebase_id, program, pairs, names, nth, section) with what it does."""
    rows = rows.select("source_file", "codebase_id", "program", "pairs", "names", "nth", "section.paragraph", "section.body", "section.lead")
    source = replace_pairs(F.concat("paragraph", F.lit(".\n"), "body"), F.col("pairs"))
    scanned = without_literals(F.concat_ws("\n", F.col("body"), F.col("lead")))
    rows = rows.select("*", source.alias("source"), without_literals(F.col("body")).alias("plain"), scanned.alias("scanned"))
    return rows.select(
        "source_file", "codebase_id", "program", "nth", "paragraph", "source", "pairs", "names", content_hash(F.col("source")).alias("hash"),
        F.concat("program", F.lit("."), "paragraph").alias("full_name"),
        _all(F.concat_ws("\n", "body", "lead"), r"(?i)CALL\s+[\"']([A-Z0-9-]+)[\"']").alias("calls"), _all(F.col("scanned"), _PERFORMED).alias("performs"), _all(F.col("plain"), r"(?i)\bGO\s+TO\s+([A-Z0-9-]+)").alias("gotos"),
        (F.lit(1) + F.regexp_count("plain", F.lit(r"(?i)\bIF\b")) + F.regexp_count("plain", F.lit(r"(?i)\bEVALUATE\b")) + F.size(F.filter(_all(F.col("plain"), _PERFORMED), lambda p: p.rlike(r"(?i)\sTHR")))).cast("bigint").alias("cyclomatic"),
        F.regexp_count("body", F.lit(r"(?m)\.\s*$")).cast("bigint").alias("statements"),
    )


def paragraphs(progs: DataFrame) -> DataFrame:
    """One row per paragraph with its text and what it calls, performs and jumps to."""
    held = progs.select("source_file", "codebase_id", "program", F.flatten(F.transform("copies", lambda c: c["pairs"])).alias("pairs"), _sections(F.col("procedure")).alias("sections"))
    names = F.transform("sections", lambda x: x["paragraph"])
    return _paragraph_rows(held.select("source_file", "codebase_id", "program", "pairs", names.alias("names"), F.posexplode("sections").alias("nth", "section"))).drop("names")


def _storage_lines(code: Column) -> Column:
    """Lines of the working storage that begin an item."""
    storage = F.regexp_extract(code, r"(?is)WORKING-STORAGE\s+SECTION\.?[^\n]*\n(.*?)(?=\n\s*(?:LINKAGE|FILE|LOCAL-STORAGE)\s+SECTION|\n\s*PROCEDURE\s+DIVISION|$)", 1)
    return F.filter(F.transform(F.split(storage, "\n"), lambda x: F.trim(x)), lambda x: x.rlike(r"^\d{1,2}\s") & ~x.startswith("88 ") & ~x.startswith("88\t"))


#: Characters of a picture as the scanner takes them: capitals, digits and editing marks.
_PICTURE = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789()$/.,+-*"


def _item(line: Column) -> Column:
    """(level, name, pic, redefines, occurs, bad, line) of a data item on one line, clause by clause."""
    given = F.split(F.rtrim(F.rtrim(F.rtrim(line), F.lit("."))), r"\s+")
    return _let(given, lambda g: _let(F.transform(g, F.upper), lambda w: _item_of(line, g, w)))


def _item_of(line: Column, given: Column, words: Column) -> Column:
    name = F.regexp_extract(F.coalesce(F.get(given, F.lit(1)), F.lit("")), "^[A-Z0-9-]+", 0)
    at = F.greatest(F.array_position(words, "PIC"), F.array_position(words, "PICTURE")).cast("int")
    picture = F.when(at > 0, F.get(given, F.when(F.get(words, at) == "IS", at + 1).otherwise(at)))
    bad = (name == "") | ~F.rtrim(line).endswith(".") | (F.translate(F.coalesce(picture, F.lit("")), _PICTURE, "") != "")
    redefines = F.regexp_extract(F.coalesce(_after(words, "REDEFINES"), F.lit("")), "^[A-Z0-9-]+", 0)
    return F.struct(
        F.get(given, F.lit(0)).cast("int").alias("level"), F.when(name == "", "UNKNOWN").otherwise(name).alias("name"), _none(picture).alias("pic"), _none(redefines).alias("redefines"),
        F.when(F.array_contains(words, "TIMES"), _after(words, "OCCURS")).try_cast("int").alias("occurs"), bad.alias("bad"), line.alias("line"),
    )


def fields(progs: DataFrame) -> DataFrame:
    """Working-storage items: level, name, picture, redefines, occurs; malformed ones are marked."""
    item = F.explode(F.transform(_storage_lines(F.col("code")), _item)).alias("item")
    return progs.select("source_file", "codebase_id", "program", item).select("source_file", "codebase_id", "program", "item.*")


def _accesses(block: Column) -> Column:
    """(access, table) of an SQL block: what stands behind FROM is read, behind INTO and UPDATE written; host variables are no tables."""
    words = F.regexp_extract_all(F.upper(block), F.lit(r"[A-Z_][A-Z0-9_]*|\S"), F.lit(0))
    named = F.filter(_pairs(words), lambda p: p["word"].rlike("^[A-Z_][A-Z0-9_]+$") & p["before"].isin("FROM", "INTO", "UPDATE") & ~((p["before"] == "UPDATE") & p["first"].eqNullSafe(F.lit("FOR"))))
    return F.transform(named, lambda p: F.struct(F.when(p["before"] == "FROM", "READS").otherwise("WRITES").alias("access"), p["word"].alias("table")))


def table_access(progs: DataFrame) -> DataFrame:
    """(program, access, table): tables that SQL blocks read and write."""
    found = F.array_distinct(F.flatten(F.transform("sql", _accesses)))
    return progs.select("source_file", "codebase_id", "program", F.explode(found).alias("a")).select("source_file", "codebase_id", "program", "a.access", "a.table")


def _of_programs(files: DataFrame) -> DataFrame:
    """One row per COBOL file with all that it holds, written once."""
    progs = programs(files)
    open_sql = F.regexp_replace("bare", r"(?is)\bEXEC\s+SQL\b.*?END-EXEC", "").rlike(r"(?i)\bEXEC\s+SQL\b")
    return cut(progs.select(
        "source_file", "codebase_id", "program", "copies", content_hash(F.col("code")).alias("hash"), open_sql.alias("open_sql"), F.exists("sql", lambda b: b.rlike(r"(?i)\bPREPARE\b|\bEXECUTE\s+IMMEDIATE\b")).alias("dynamic"),
        F.transform(_storage_lines(F.col("code")), _item).alias("items"), F.array_distinct(F.flatten(F.transform("sql", _accesses))).alias("accesses"), _sections(F.col("procedure")).alias("sections"),
        F.flatten(F.transform("copies", lambda c: c["pairs"])).alias("pairs"),
    ))


def cobol(files: DataFrame) -> Extract:
    progs = _of_programs(files)
    names = F.transform("sections", lambda x: x["paragraph"])
    paras = cut(_paragraph_rows(progs.select("source_file", "codebase_id", "program", "pairs", names.alias("names"), F.posexplode("sections").alias("nth", "section"))))
    items = progs.select("source_file", "codebase_id", "program", F.explode("items").alias("i")).select("source_file", "codebase_id", "program", "i.*")
    density = F.round(F.size("gotos") / F.greatest("statements", F.lit(1)), 4)
    para_props = properties(
        parent_program=F.col("program"), cyclomatic_complexity=F.col("cyclomatic"), goto_density=density, statement_count=F.col("statements"), calls=F.col("calls"), performs=F.col("performs"),
        gotos=F.col("gotos"), replacing_applied=F.size("pairs") > 0, post_expansion=F.size("pairs") > 0, source=F.col("source"),
    )
    odd_fields = F.array_sort(F.transform(F.filter("items", lambda i: i["bad"]), lambda i: F.concat(F.lit("malformed field "), i["name"])))
    anomalies = F.concat(F.when(F.col("open_sql"), F.array(F.lit("unterminated EXEC SQL block"))).otherwise(F.array().cast("array<string>")), odd_fields)
    called = paras.select("source_file", "codebase_id", "program", "full_name", F.explode(F.array_distinct(F.transform("calls", F.upper))).alias("target"))
    access = progs.select("source_file", "codebase_id", "program", F.explode("accesses").alias("a")).select("source_file", "codebase_id", "program", "a.access", "a.table")
    nodes = [
        progs.withColumn("anomalies", anomalies).select(*_node("Program", F.col("program"), F.col("hash"), F.when(F.size("anomalies") > 0, 0.5).otherwise(1.0), properties(source_file=F.col("source_file"), paragraph_count=F.size("sections").cast("bigint"), anomalies=F.col("anomalies"), dynamic_sql=F.when(F.col("dynamic"), F.lit(True))))),
        paras.select(*_node("Paragraph", F.col("full_name"), F.col("hash"), 1.0, para_props)),
        items.select(*_node("Field", F.concat("program", F.lit("."), "name"), content_hash(F.col("line")), F.when(F.col("bad"), 0.5).otherwise(1.0), properties(level=F.col("level"), parent_program=F.col("program"), pic=F.col("pic"), redefines=F.col("redefines"), occurs=F.col("occurs"), anomaly=F.when(F.col("bad"), F.lit(True))))),
        called.where(F.col("target") != F.col("program")).select(*_node("Program", F.col("target"), None, 0.0, properties(placeholder=F.lit(True), seen_via=F.lit("CALL")))),
        access.select(*_node("DB2Table", F.col("table"), None, 1.0, properties(source=F.lit("EXEC SQL (created on demand)")))),
    ]
    edges = [
        called.select(*_edge(_cb(F.col("full_name"), "Paragraph"), _cb(F.col("target"), "Program"), "CALLS")),
        performs(paras), jumps(paras),
        progs.select("codebase_id", "program", F.explode("copies").alias("c")).select(*_edge(_cb(F.col("program"), "Program"), _cb(F.col("c.copybook"), "Copybook"), "INCLUDES", properties(replacing=F.col("c.pairs")))),
        access.select(*_edge(_cb(F.col("program"), "Program"), _cb(F.col("table"), "DB2Table"), F.col("access"))),
    ]
    units = paras.select(F.lit("paragraph").alias("kind"), F.col("full_name").alias("name"), "source", F.col("hash").alias("content_hash"), _cb(F.col("full_name"), "Paragraph").alias("node_id"), "source_file", "codebase_id")
    return Extract(_union(nodes), _union(edges), units)


def performs(paras: DataFrame) -> DataFrame:
    """PERFORMS edges: to the paragraph of the same program, or from the program to the unresolved name."""
    aim = lambda p: F.struct(F.upper(F.regexp_extract(p, r"^([A-Za-z0-9-]+)", 1)).alias("target"), F.upper(F.regexp_extract(p, r"(?i)(?:THRU|THROUGH)\s+([A-Z0-9-]+)$", 1)).alias("end"))
    p = paras.select("codebase_id", "program", "full_name", "names", F.explode(F.array_distinct(F.transform("performs", aim))).alias("p"))
    p = p.select("codebase_id", "program", "full_name", "p.target", "p.end", F.array_contains("names", F.col("p.target")).alias("known"))
    thru = _none(F.col("end"))
    return p.select(*_edge(
        F.when(F.col("known"), _cb(F.col("full_name"), "Paragraph")).otherwise(_cb(F.col("program"), "Program")), _cb(F.concat("program", F.lit("."), "target"), "Paragraph"), "PERFORMS",
        properties(thru=thru.isNotNull(), range_end=thru, unresolved=F.when(~F.col("known"), F.lit(True))),
    ))


def jumps(paras: DataFrame) -> DataFrame:
    """GO TO edges, only to paragraphs that exist."""
    g = paras.select("codebase_id", "program", "full_name", F.explode(F.array_intersect(F.transform("gotos", F.upper), F.col("names"))).alias("target"))
    return g.select(*_edge(_cb(F.col("full_name"), "Paragraph"), _cb(F.concat("program", F.lit("."), "target"), "Paragraph"), "PERFORMS", properties(goto=F.lit(True))))


# ---------------------------------------------------------------- copybooks

def _entry_of(group: Column) -> Column:
    """(level, name, pic, redefines, occurs, bad, entry, conditions) of a field entry with the condition names that follow it."""
    given = lambda entry: F.split(entry, " ")
    return _let(F.substring_index(group, "\n", 1), lambda e: _let(given(e), lambda g: _let(F.transform(g, F.upper), lambda w: _entry_words(group, e, g, w))))


def _entry_words(group: Column, entry: Column, given: Column, words: Column) -> Column:
    name = F.regexp_extract(F.coalesce(F.get(words, F.lit(1)), F.lit("")), "^[A-Z0-9-]+", 0)
    at = F.greatest(F.array_position(words, "PIC"), F.array_position(words, "PICTURE")).cast("int")
    picture = F.when(at > 0, F.get(given, F.when(F.get(words, at) == "IS", at + 1).otherwise(at)))
    bad = (name == "") | name.isin("PIC", "PICTURE") | (F.translate(F.coalesce(F.upper(picture), F.lit("")), _PICTURE, "") != "")
    redefines = F.regexp_extract(F.coalesce(_after(words, "REDEFINES"), F.lit("")), "^[A-Z0-9-]+", 0)
    more = F.filter(F.split(group, "\n"), lambda x: x.startswith("88 "))
    return F.struct(
        F.get(given, F.lit(0)).cast("int").alias("level"), F.when(name == "", "UNKNOWN").otherwise(name).alias("name"), _none(picture).alias("pic"), bad.alias("bad"), entry.alias("entry"), _none(redefines).alias("redefines"),
        F.regexp_extract(F.coalesce(_after(words, "OCCURS"), F.lit("")), r"^\d+", 0).try_cast("int").alias("occurs"),
        F.filter(F.transform(more, lambda x: F.regexp_extract(F.upper(F.element_at(F.split(x, " "), 2)), "^[A-Z0-9-]+", 0)), lambda x: x != "").alias("conditions"),
    )


def copybook(files: DataFrame) -> Extract:
    """Copybooks and their fields, with replacements that the file itself names applied; condition names (level 88) belong to the nearest field before them."""
    raw = F.array_join(lines(F.col("text")), "\n")
    named = F.transform(F.regexp_extract_all(raw, F.lit(r"==([A-Za-z0-9-]+)==\s+BY\s+==[A-Za-z0-9-]+=="), F.lit(0)), lambda x: F.struct(F.element_at(F.split(x, "=="), 2).alias("from"), F.element_at(F.split(x, "=="), 4).alias("to")))
    f = of_kind(files, "copybook").select("source_file", "codebase_id", F.upper(stem(F.col("source_file"))).alias("book"), named.alias("named"), raw.alias("raw"))
    area = F.array_join(F.filter(F.transform(F.split(replace_pairs(F.col("raw"), F.col("named")), "\n"), content_area), lambda x: F.trim(x) != ""), "\n")
    f = f.select("source_file", "codebase_id", "book", (F.size("named") > 0).alias("replacing"), area.alias("code"))
    # Entries run to a period at a line end; a field takes the level-88 entries up to the next field with it.
    entries = F.filter(F.transform(F.split("code", r"\.[ \t]*(?:\n|$)"), lambda e: squeeze(e)), lambda e: e.rlike(r"^\d{1,2}(?:\s|$)"))
    groups = F.filter(F.split(F.array_join(entries, "\n"), r"\n(?!88\s)"), lambda g: (g != "") & ~g.startswith("88 "))
    f = cut(f.select("source_file", "codebase_id", "book", "replacing", "code", content_hash(F.col("code")).alias("hash"), F.transform(groups, _entry_of).alias("items")))
    items = f.select("source_file", "codebase_id", "book", F.explode("items").alias("i")).select("source_file", "codebase_id", "book", "i.*")
    broken = F.exists("items", lambda i: i["bad"])
    nodes = [
        f.select(*_node("Copybook", F.col("book"), F.col("hash"), F.when(broken, 0.5).otherwise(1.0), properties(source_file=F.col("source_file"), replacing_applied=F.col("replacing"), anomalies=F.when(broken, F.array(F.lit("malformed data entry")))))),
        items.select(*_node("Field", F.concat("book", F.lit("."), "name"), content_hash(F.col("entry")), F.when(F.col("bad"), 0.5).otherwise(1.0), properties(level=F.col("level"), parent_copybook=F.col("book"), pic=F.col("pic"), redefines=F.col("redefines"), occurs=F.col("occurs"), condition_names=F.when(F.size("conditions") > 0, F.col("conditions"))))),
    ]
    none_edge = f.limit(0).select(*_edge(F.col("book"), F.col("book"), "DERIVED_FROM"))
    return Extract(_union(nodes), none_edge, f.select(F.lit("copybook").alias("kind"), F.col("book").alias("name"), F.col("code").alias("source"), F.col("hash").alias("content_hash"), _cb(F.col("book"), "Copybook").alias("node_id"), "source_file", "codebase_id"))


# ---------------------------------------------------------------- JCL

def jcl_parts(files: DataFrame) -> DataFrame:
    """JCL files with statements put on one line each, cut at their EXEC cards: (job, nth, part)."""
    text = F.array_join(lines(F.col("text")), "\n")
    text = F.regexp_replace(text, r"(?m)^//\*[^\n]*(?:\n|$)", "")
    # A card that ends with a comma takes the next one, which may go on itself (\G is where the last match ended).
    text = F.regexp_replace(text, r"(?m)(?:^(//[^\n]*,)|\G(?!\A)([^\n]*,))[ \t]*\n//[ \t]+(?=\S)", "$1$2")
    f = of_kind(files, "jcl").select("source_file", "codebase_id", text.alias("code"))
    job = F.upper(F.regexp_extract("code", r"(?m)^//([A-Za-z0-9@#$.\-]+)[ \t]+(?i:JOB)\b", 1))
    parts = F.split(F.concat(F.lit("\n"), "code"), r"(?m)^(?=//[A-Za-z0-9@#$.\-]*[ \t]+(?i:EXEC)[ \t])", -1)
    return f.select("source_file", "codebase_id", "code", F.when(job != "", job).otherwise("UNKNOWN").alias("job"), F.posexplode(parts).alias("nth", "part"))


def _operands(text: Column) -> Column:
    """Operands of a card, cut at the commas outside parentheses and literals (up to three levels of parentheses)."""
    whole = lambda t: F.length(t) - F.length(F.replace(t, F.lit("'"), F.lit("")))
    field = _let(text, lambda t: F.when(whole(t) % 2 == 0, F.regexp_extract(t, r"^(?:'[^'\n]*'|[^\s'])*+", 0)).otherwise(t))  # of a broken literal everything is kept
    inner = r"\([^()]*+\)"
    for _ in range(2):
        inner = rf"\((?:'[^']*+'|{inner}|[^()'])*+\)"
    return F.regexp_extract_all(field, F.lit(rf"(?:'[^']*+'|{inner}|[^,'()]|['()])+"), F.lit(0))


def _keyed(operands: Column, *keys: str) -> Column:
    """Value of the first operand ``KEY=value``, quotes taken off; empty if there is none."""
    hit = F.filter(operands, lambda o: F.upper(F.trim(F.substring_index(o, "=", 1))).isin(*keys) & F.contains(o, F.lit("=")))
    return F.coalesce(F.btrim(F.regexp_replace(F.get(hit, F.lit(0)), r"^[^=]*=\s*", ""), F.lit("'")), F.lit(""))


def _dd(card: Column) -> Column:
    """(name, dsn, status, normal) of a DD card: data set, and the first two words of its disposition."""
    return _let(_operands(F.regexp_extract(card, r"(?i)^\S*[ \t]+DD[ \t]+(.*)$", 1)), lambda operands: _dd_of(card, operands))


def _dd_of(card: Column, operands: Column) -> Column:
    disposition = F.transform(F.split(F.btrim(_keyed(operands, "DISP"), F.lit("()")), ","), lambda x: F.upper(F.trim(x)))
    return F.struct(
        F.upper(F.regexp_extract(card, r"^(\S+)", 1)).alias("name"), F.upper(F.regexp_extract(_keyed(operands, "DSN", "DSNAME"), r"^[^,\s()]+", 0)).alias("dsn"),
        F.get(disposition, F.lit(0)).alias("status"), F.coalesce(F.get(disposition, F.lit(1)), F.lit("")).alias("normal"),
    )


def jcl(files: DataFrame) -> Extract:
    p = jcl_parts(files)
    p = p.withColumn("card", F.substring_index("part", "\n", 1))
    p = p.withColumn("exec", _operands(F.regexp_extract("card", r"(?i)^\S*[ \t]+EXEC[ \t]+(.*)$", 1))).withColumn("job_card", F.when(F.col("nth") == 0, _operands(F.regexp_extract("part", r"(?im)^//\S*[ \t]+JOB[ \t]+(.*)$", 1))))
    card, operands, job_operands = F.col("card"), F.col("exec"), F.col("job_card")
    account = F.get(job_operands, F.lit(0))
    first = F.coalesce(F.get(operands, F.lit(0)), F.lit(""))
    p = p.withColumn("pgm", F.upper(F.regexp_extract(_keyed(operands, "PGM"), r"^[^,\s()]+", 0)))
    pgm = F.col("pgm")
    proc = F.when(F.col("pgm") == "", F.upper(F.when(F.contains(first, F.lit("=")), _keyed(F.slice(operands, 1, 1), "PROC")).otherwise(F.regexp_extract(first, r"^[A-Za-z0-9@#$]+$", 0)))).otherwise("")
    # Lines outside in-stream data that are neither a card nor a remark are odd.
    known = r"(?i)^//(?:[A-Za-z0-9@#$]\S*)?[ \t]+(?:JOB|EXEC|DD|IF|THEN|ELSE|ENDIF|OUTPUT|JCLLIB|INCLUDE|SET|COMMAND|PROC|PEND)(?:\s|$)"
    odd = F.filter(F.split("part", "\n"), lambda x: x.startswith("//") & ~x.startswith("//*") & x.rlike(r"^//(?:\S*[ \t]+\S|[^\sA-Za-z0-9@#$])") & ~x.rlike(known))
    p = p.withColumn("label", F.upper(F.regexp_extract("card", r"^//([A-Za-z0-9@#$.\-]*)", 1)))
    label = F.col("label")
    conditions = F.transform(_all(F.col("part"), r"(?im)^//\S*[ \t]+((?:IF|THEN|ELSE|ENDIF)\b.*)$"), lambda x: F.concat(F.upper(F.regexp_extract(x, r"^\w+", 0)), F.lit(": "), F.coalesce(_none(F.trim(F.regexp_replace(x, r"^\w+", ""))), F.upper(F.regexp_extract(x, r"^\w+", 0)))))
    p = cut(p.select(
        "source_file", "codebase_id", "job", "nth", "part", F.when(label == "", "ANONSTEP").otherwise(label).alias("step"), pgm.alias("pgm"), proc.alias("proc"), F.btrim(_keyed(operands, "COND"), F.lit("()")).alias("cond"), conditions.alias("conditions"),
        F.when(F.col("nth") == 0, content_hash(F.col("code"))).alias("job_hash"), content_hash(F.col("part")).alias("hash"), job_operands.alias("operands"), F.when(~account.rlike("^[A-Za-z]+="), account).alias("accounting"),
        F.when(F.col("nth") > 0, F.transform(_all(F.col("part"), r"(?im)^//(\S*[ \t]+DD[ \t]+.*)$"), _dd)).alias("dds"), odd.alias("odd"),
    ))
    heads, steps = p.where("nth = 0"), p.where("nth > 0")
    key = lambda k: _none(F.regexp_extract(_keyed(F.col("operands"), k), r"^[\w.\-]+", 0))
    dds = steps.select("source_file", "codebase_id", "step", F.explode("dds").alias("d")).select("source_file", "codebase_id", "step", "d.*").where("dsn <> ''")
    lineage = F.when(F.col("status").isin("SHR", "OLD"), F.array(F.lit("READS"))).when((F.col("status") == "MOD") & (F.col("normal") == "DELETE"), F.array(F.lit("READS"), F.lit("WRITES"))).when(F.col("status").isin("NEW", "MOD"), F.array(F.lit("WRITES"))).otherwise(F.array().cast("array<string>"))
    strange = p.select("source_file", "codebase_id", "job", F.explode("odd").alias("line"))
    step_id = _cb(F.col("step"), "JCLStep")
    nodes = [
        heads.select(*_node("JCLJob", F.col("job"), F.col("job_hash"), 1.0, properties(**{"class": key("CLASS"), "msgclass": key("MSGCLASS"), "restart": key("RESTART"), "accounting": F.col("accounting")}))),
        steps.select(*_node("JCLStep", F.col("step"), F.col("hash"), 1.0, properties(parent_job=F.col("job"), step_number=F.col("nth"), exec_kind=F.when(F.col("pgm") != "", "PROGRAM").otherwise("PROC"), program=_none(F.col("pgm")), proc=_none(F.col("proc")), cond=_none(F.col("cond")), conditions=F.when(F.size("conditions") > 0, F.col("conditions"))))),
        strange.select(*_node("JCLStep", F.concat(F.lit("ANOMALY-"), F.substring(F.md5("line"), 1, 8)), None, 0.5, properties(parent_job=F.col("job"), anomaly=F.lit(True), operands=F.col("line")))),
        dds.select(*_node("Dataset", F.col("dsn"), None, 1.0, properties(dds=F.array("name")))),
        steps.where("pgm <> ''").select(*_node("Program", F.col("pgm"), None, 0.0, properties(placeholder=F.lit(True), seen_via=F.lit("EXEC")))),
    ]
    edges = [
        steps.where("pgm <> ''").select(*_edge(step_id, _cb(F.col("pgm"), "Program"), "EXECUTES")),
        dds.select("*", F.explode(lineage).alias("access")).select(*_edge(step_id, _cb(F.col("dsn"), "Dataset"), F.col("access"), properties(dd=F.col("name")))),
    ]
    units = steps.select(F.lit("job_step").alias("kind"), F.concat("job", F.lit("."), "step").alias("name"), F.col("part").alias("source"), F.col("hash").alias("content_hash"), step_id.alias("node_id"), "source_file", "codebase_id")
    return Extract(_union(nodes), _union(edges), units)


# ---------------------------------------------------------------- DDL, triggers, procedures

_NAME = r"[A-Za-z_][\w$#]*(?:\.[A-Za-z_][\w$#]*)?"


def _ddl_text(files: DataFrame, kind: str) -> DataFrame:
    return of_kind(files, kind).select("source_file", "codebase_id", F.regexp_replace(F.array_join(lines(F.col("text")), "\n"), r"--[^\n]*", "").alias("code"))


def _is_constraint(entry: Column) -> Column:
    return F.upper(F.regexp_extract(entry, r"^\w+", 0)).isin("CONSTRAINT", "PRIMARY", "FOREIGN", "CHECK", "UNIQUE")


def _is_key(entry: Column) -> Column:
    return entry.rlike(r"(?i)\bPRIMARY\s+KEY\b")


def ddl(files: DataFrame) -> Extract:
    """Tables with columns, constraints and cascades, indexes and views."""
    body = lambda stmt: F.regexp_extract(stmt, r"(?s)\((.*)\)[^;)]*;$", 1)
    parts = lambda stmt: F.filter(F.transform(F.split(body(stmt), r",(?![^()]*\))"), lambda x: squeeze(x)), lambda x: x != "")  # noqa: E731  # commas outside parentheses
    statements = F.transform(_all(F.col("code"), rf"(?is)(CREATE\s+TABLE\s+{_NAME}\s*\(.*?\)[^;)]*;)"), lambda x: F.struct(
        x.alias("stmt"), F.upper(F.regexp_extract(x, r"(?i)CREATE\s+TABLE\s+(?:\w+\.)?([A-Za-z_][\w$#]*)", 1)).alias("table"), parts(x).alias("entries"),
    ))
    f = cut(_ddl_text(files, "ddl").select(
        "source_file", "codebase_id", statements.alias("tables"), _all(F.col("code"), rf"(?i)(CREATE\s+(?:UNIQUE\s+)?INDEX\s+{_NAME}\s+ON\s+{_NAME}\s*\([^)]*\)\s*;)").alias("indexes"), _all(F.col("code"), rf"(?is)(CREATE\s+VIEW\s+{_NAME}\s.*?;)").alias("views"),
    ))
    first = lambda e: F.upper(F.regexp_extract(e, r"^([A-Za-z_][\w$#]*)", 1))
    type_of = lambda e: F.upper(F.regexp_extract(e, r"^[A-Za-z_][\w$#]*\s+([A-Za-z]\w*(?:\s*\([^)]*\))?)", 1))
    listed = lambda e: F.upper(F.regexp_replace(F.regexp_extract(e, r"(?i)(?:KEY|UNIQUE)\s*\(([^)]*)\)", 1), r"\s", ""))
    t = f.select("source_file", "codebase_id", F.explode("tables").alias("t")).select("source_file", "codebase_id", "t.*")
    columns = F.filter("entries", lambda e: ~_is_constraint(e))
    keys = F.flatten(F.transform(F.filter("entries", _is_key), lambda e: F.when(_is_constraint(e), F.split(listed(e), ",")).otherwise(F.array(first(e)))))
    t = t.select("*", columns.alias("columns"), keys.alias("keys"))
    cols = t.select("source_file", "codebase_id", "table", "keys", F.explode("columns").alias("entry")).select("*", first(F.col("entry")).alias("column"), type_of(F.col("entry")).alias("kind"))
    e = t.select("source_file", "codebase_id", "table", F.explode(F.filter("entries", lambda e: _is_constraint(e) | _is_key(e))).alias("entry"))
    own = _is_constraint(F.col("entry"))
    kind = F.when(~own, "PK").when(F.col("entry").rlike(r"(?i)\bFOREIGN\s+KEY\b"), "FK").when(_is_key(F.col("entry")), "PK").when(F.col("entry").rlike(r"(?i)\bCHECK\b"), "CHECK").otherwise("UNIQUE")
    given = F.when(own, F.upper(F.regexp_extract("entry", r"(?i)^CONSTRAINT\s+([A-Za-z_][\w$#]*)", 1))).otherwise("")
    suffix = F.create_map(F.lit("FK"), F.lit("_FK"), F.lit("PK"), F.lit("_PK"), F.lit("CHECK"), F.lit("_CHK"), F.lit("UNIQUE"), F.lit("_UNQ"))
    cons = e.select("*", kind.alias("ckind")).select(
        "*", F.when(given != "", given).otherwise(F.concat("table", F.element_at(suffix, F.col("ckind")))).alias("cname"),
        F.when(own, F.upper(F.regexp_extract("entry", r"(?i)\bREFERENCES\s+(?:\w+\.)?([A-Za-z_][\w$#]*)", 1))).otherwise("").alias("ref"), F.when(own, listed(F.col("entry"))).otherwise(first(F.col("entry"))).alias("cols"),
    )
    cascades = cons.where((F.col("ckind") == "FK") & F.col("entry").rlike(r"(?i)\bON\s+(DELETE|UPDATE)\s+CASCADE\b") & (F.col("ref") != ""))
    ix = f.select("source_file", "codebase_id", F.explode("indexes").alias("stmt"))
    ix = ix.select("*", F.upper(F.regexp_extract("stmt", rf"(?i)INDEX\s+({_NAME})", 1)).alias("index"), F.upper(F.regexp_extract("stmt", rf"(?i)\sON\s+({_NAME})", 1)).alias("table"))
    v = f.select("source_file", "codebase_id", F.explode("views").alias("stmt"))
    before = F.regexp_replace("stmt", r"(?is)\bWHERE\b.*$", "")
    v = v.select("*", F.upper(F.regexp_extract("stmt", rf"(?i)VIEW\s+({_NAME})", 1)).alias("view"), F.array_distinct(F.transform(_all(before, rf"(?i)\b(?:FROM|JOIN)\s+({_NAME})"), F.upper)).alias("tables"))
    none = F.size("columns") == 0
    confidence = F.when(none, 0.4).when(F.exists("columns", lambda c: type_of(c) == ""), 0.6).otherwise(1.0)
    nodes = [
        t.select(*_node("DB2Table", F.col("table"), content_hash(F.col("stmt")), confidence, properties(columns=F.when(~none, F.array_sort(F.transform("columns", first))), source_file=F.col("source_file")))),
        cols.where("column <> ''").select(*_node("DB2Column", F.concat("table", F.lit("."), "column"), content_hash(F.col("entry")), 1.0, properties(parent_table=F.col("table"), type=F.col("kind"), not_null=F.col("entry").rlike(r"(?i)\bNOT\s+NULL\b"), is_pk=F.array_contains("keys", F.col("column"))))),
        cons.select(*_node("Constraint", F.col("cname"), content_hash(F.col("entry")), F.when(F.col("ckind") == "PK", 1.0).when(F.col("ckind") != "FK", 0.9).when(F.col("ref") != "", 0.95).otherwise(0.4), properties(kind=F.col("ckind"), table=F.col("table"), cols=_none(F.col("cols")), references=_none(F.col("ref"))))),
        ix.select(*_node("Constraint", F.col("index"), content_hash(F.col("stmt")), 0.9, properties(kind=F.lit("INDEX"), table=F.col("table")))),
        v.select(*_node("View", F.col("view"), content_hash(F.col("stmt")), F.when(F.size("tables") > 0, 1.0).otherwise(0.6), properties(underlying_tables=F.col("tables"), defining_sql=squeeze(F.col("stmt"))))),
    ]
    edges = [
        cascades.select(*_edge(_cb(F.col("table"), "DB2Table"), _cb(F.col("ref"), "DB2Table"), "CASCADES_TO")),
        v.select("codebase_id", "view", F.explode("tables").alias("t")).select(*_edge(_cb(F.col("view"), "View"), _cb(F.col("t"), "DB2Table"), "ABSTRACTS")),
    ]
    units = [t.select(*_unit("table", F.col("table"), F.col("stmt"), _cb(F.col("table"), "DB2Table"))), v.select(*_unit("view", F.col("view"), F.col("stmt"), _cb(F.col("view"), "View"))), ix.select(*_unit("index", F.col("index"), F.col("stmt"), _cb(F.col("index"), "Constraint")))]
    return Extract(_union(nodes), _union(edges), _union(units))


def _complexity(body: Column) -> Column:
    return (F.lit(1) + F.regexp_count(body, F.lit(r"(?i)\b(?:IF|WHILE|FOR|CASE)\b"))).cast("bigint")


def _first_of(words: Column, *any_of: str) -> Column:
    return F.coalesce(F.get(F.filter(words, lambda w: w.isin(*any_of)), F.lit(0)), F.lit(""))


def triggers(files: DataFrame) -> Extract:
    """Triggers, what they fire on, and the chain that their statements imply (unless NO CASCADE)."""
    f = _ddl_text(files, "trigger")
    t = f.select("source_file", "codebase_id", F.explode(_all(F.col("code"), rf"(?is)(CREATE\s+TRIGGER\s+{_NAME}.*?\bEND\s*;)")).alias("stmt"))
    begin = F.regexp_instr(F.upper("stmt"), F.lit(r"\bBEGIN\b"))
    t = t.select("*", F.when(begin > 0, F.substring(F.col("stmt"), F.lit(1), begin - 1)).otherwise(F.col("stmt")).alias("head"), F.when(begin > 0, F.substring(F.col("stmt"), begin + 5, F.length("stmt"))).otherwise("").alias("body"))
    t = t.withColumn("words", F.regexp_extract_all(F.upper("head"), F.lit(r"[A-Z_][\w$#]*(?:\.[A-Z_][\w$#]*)?|[^\s\w]"), F.lit(0)))
    word = lambda *keys: F.coalesce(_after(F.col("words"), *keys), F.lit(""))
    timing = _first_of(F.col("words"), "BEFORE", "AFTER", "INSTEAD")
    between = F.regexp_extract("head", r"(?is)\bREFERENCING\b(.*?)(?:\bFOR\b|\bMODE\b|\bWHEN\b|$)", 1)
    t = cut(t.select(
        "source_file", "codebase_id", "stmt", "body", word("TRIGGER").alias("trigger"), F.when(timing == "INSTEAD", "INSTEAD OF").otherwise(timing).alias("timing"), _first_of(F.col("words"), "INSERT", "DELETE", "UPDATE").alias("event"),
        word("ON").alias("table"), F.exists(_pairs(F.col("words")), lambda p: (p["before"] == "NO") & (p["word"] == "CASCADE")).alias("no_cascade"), word("EACH").alias("granularity"),
        F.filter(F.split(squeeze(between), r"\s+(?=(?i:NEW|OLD)\b)"), lambda x: x != "").alias("referencing"), word("MODE").alias("mode"),
    ))
    dml = F.transform(_all(F.col("body"), rf"(?i)\b((?:INSERT\s+INTO|UPDATE|DELETE\s+FROM)\s+{_NAME})"), lambda d: F.struct(F.upper(F.regexp_extract(d, r"(?i)^(INSERT|UPDATE|DELETE)", 1)).alias("event"), F.upper(F.regexp_extract(d, r"(\S+)$", 1)).alias("table")))
    chain = t.where("not no_cascade").select("codebase_id", "trigger", F.col("table").alias("own"), F.explode(F.array_distinct(dml)).alias("d")).where("d.table <> own")
    props = properties(timing=F.col("timing"), event=F.col("event"), base_event=F.col("event"), table=F.col("table"), referencing=F.col("referencing"), granularity=F.col("granularity"), mode=F.col("mode"), no_cascade=F.col("no_cascade"), complexity_score=_complexity(F.col("body")), body_hash=content_hash(F.col("body")))
    nodes = t.select(*_node("Trigger", F.col("trigger"), content_hash(F.col("stmt")), F.when(F.col("body") == "", 0.5).otherwise(1.0), props))
    edges = [
        t.where("table <> ''").select(*_edge(_cb(F.col("trigger"), "Trigger"), _cb(F.col("table"), "DB2Table"), "FIRES_ON")),
        chain.select(*_edge(_cb(F.col("trigger"), "Trigger"), F.concat(F.lit("Trigger:"), "codebase_id", F.lit(":ON:"), "d.table", F.lit(":"), "d.event"), "TRIGGERS_TRIGGER", properties(inferred=F.lit(True)))),
    ]
    return Extract(nodes, _union(edges), t.select(*_unit("trigger", F.col("trigger"), F.col("stmt"), _cb(F.col("trigger"), "Trigger"))))


def procedures(files: DataFrame) -> Extract:
    """SQL procedures and functions: parameters, tables read and written, procedures called."""
    f = _ddl_text(files, "sqlpl")
    p = f.select("source_file", "codebase_id", F.explode(_all(F.col("code"), rf"(?is)(CREATE\s+(?:PROCEDURE|FUNCTION)\s+{_NAME}\s*\(.*?\bEND\s+(?:PROCEDURE|FUNCTION)\s*;)")).alias("stmt"))
    body = F.regexp_extract("stmt", r"(?is)\bBEGIN\b(.*)$", 1)
    up = lambda pattern: F.array_sort(F.array_distinct(F.transform(_all(F.col("body"), pattern), F.upper)))
    p = p.select("*", body.alias("body"), F.upper(F.regexp_extract("stmt", rf"(?i)(?:PROCEDURE|FUNCTION)\s+({_NAME})", 1)).alias("name"), F.upper(F.regexp_extract("stmt", r"(?i)CREATE\s+(PROCEDURE|FUNCTION)", 1)).alias("kind"), F.upper(F.regexp_extract("stmt", r"(?i)LANGUAGE\s+(SQL|COBOL|JAVA|C)", 1)).alias("language"), F.regexp_extract("stmt", r"(?is)\((.*?)\)\s*(?:LANGUAGE|RETURNS|DYNAMIC|BEGIN|MODIFIES|READS|SPECIFIC|NOT|DETERMINISTIC)", 1).alias("params"))
    p = p.select("*", up(rf"(?i)\bCALL\s+({_NAME})\s*\(").alias("called"), F.array_sort(F.array_distinct(F.concat(up(rf"(?i)\bINSERT\s+INTO\s+({_NAME})"), up(rf"(?i)\bUPDATE\s+({_NAME})\s+SET\b"), up(rf"(?i)\bDELETE\s+FROM\s+({_NAME})")))).alias("writes"), up(rf"(?is)\bSELECT\b.*?\bFROM\s+({_NAME})").alias("reads"))
    p = cut(p.withColumn("called", F.filter("called", lambda c: c != F.col("name"))))
    parameters = F.filter(F.transform(F.split("params", r",(?![^()]*\))"), lambda x: squeeze(x)), lambda x: x != "")
    nodes = p.select(*_node("StoredProcedure", F.col("name"), content_hash(F.col("stmt")), F.when(F.col("body") == "", 0.5).otherwise(1.0), properties(language=F.col("language"), kind=F.col("kind"), parameters=parameters, complexity_score=_complexity(F.col("body")), called_procs=F.col("called"), reads=F.col("reads"), writes=F.col("writes"), source=F.lit("ddl_export"))))
    me = _cb(F.col("name"), "StoredProcedure")
    edges = [
        p.select("codebase_id", "name", F.explode("called").alias("x")).select(*_edge(me, _cb(F.col("x"), "StoredProcedure"), "INVOKES_PROC")),
        p.select("codebase_id", "name", F.explode("reads").alias("x")).select(*_edge(me, _cb(F.col("x"), "DB2Table"), "READS")),
        p.select("codebase_id", "name", F.explode("writes").alias("x")).select(*_edge(me, _cb(F.col("x"), "DB2Table"), "WRITES")),
    ]
    return Extract(nodes, _union(edges), p.select(*_unit("stored_procedure", F.col("name"), F.col("stmt"), me)))


# ---------------------------------------------------------------- VSAM, BMS

def _clause(text: Column) -> Column:
    """(file, external, organization, access, key, alternate) of a SELECT clause, word by word; IS and MODE carry nothing."""
    return _let(F.filter(F.transform(F.split(squeeze(F.upper(text)), " "), lambda x: F.rtrim(x, F.lit("."))), lambda x: ~x.isin("IS", "MODE", "")), _clause_of)


def _clause_of(w: Column) -> Column:
    keys = F.filter(F.transform(w, lambda x, i: F.struct(F.get(w, i - 3).alias("zeroth"), F.get(w, i - 2).alias("first"), F.get(w, i - 1).alias("before"), x.alias("word"))), lambda p: (p["first"] == "RECORD") & (p["before"] == "KEY"))
    other = lambda p: p["zeroth"].eqNullSafe(F.lit("ALTERNATE"))
    kind, access = F.coalesce(_after(w, "ORGANIZATION"), F.lit("")), F.coalesce(_after(w, "ACCESS"), F.lit(""))
    return F.struct(
        F.coalesce(_after(w, "SELECT", skip="OPTIONAL"), F.lit("")).alias("file"), F.coalesce(_after(w, "ASSIGN", skip="TO"), F.lit("")).alias("external"),
        F.when(kind == "LINE", F.concat_ws(" ", F.lit("LINE"), _after(w, "LINE"))).when(kind.isin("SEQUENTIAL", "INDEXED", "RELATIVE"), kind).otherwise("").alias("organization"),
        F.when(access.isin("SEQUENTIAL", "RANDOM", "DYNAMIC"), access).otherwise("").alias("access"),
        F.coalesce(F.get(F.filter(keys, lambda p: ~other(p)), F.lit(0))["word"], F.lit("")).alias("key"), F.transform(F.filter(keys, other), lambda p: p["word"]).alias("alternate"),
    )


def vsam(files: DataFrame) -> Extract:
    """Files of COBOL programs: organisation, keys, and the verbs that read and write them."""
    f = of_kind(files, "vsam").select("source_file", "codebase_id", F.array_join(F.transform(lines(F.col("text")), content_area), "\n").alias("code"))
    files_section = F.regexp_replace("code", r"(?is)\bDATA\s+DIVISION.*$", "")
    procedure = F.regexp_extract("code", r"(?is)\bPROCEDURE\s+DIVISION(.*)$", 1)
    # The record of a file: the first entry after its FD.
    descriptions = _all(F.col("code"), r"(?is)(\bFD\s+[\w-]+.*?)(?=\bFD\b|\bSD\b|PROCEDURE\s+DIVISION|WORKING-STORAGE|LINKAGE|\z)")
    entry = lambda d: F.get(F.filter(F.transform(F.split(d, "\n"), lambda x: squeeze(x)), lambda x: x.rlike(r"^\d")), F.lit(0))
    records = F.transform(descriptions, lambda d: F.struct(F.rtrim(F.upper(F.get(F.split(squeeze(d), " "), F.lit(1))), F.lit(".")).alias("file"), F.rtrim(F.upper(F.coalesce(F.get(F.split(entry(d), " "), F.lit(1)), F.lit(""))), F.lit(".")).alias("record")))
    words = _pairs(F.regexp_extract_all(procedure, F.lit(r"[A-Za-z0-9-]+|[^\sA-Za-z0-9-]"), F.lit(0)))
    verbs = F.filter(words, lambda p: p["before"].isin("READ", "DELETE", "START", "WRITE", "REWRITE") & p["word"].rlike("^[A-Z0-9-]+$"))
    clauses = F.transform(_all(files_section, r"(?is)(\bSELECT\s+\S+\s+ASSIGN\b.*?)(?=\bSELECT\b|\z)"), lambda c: F.struct(c.alias("clause"), _clause(c).alias("c")))
    f = f.select("source_file", "codebase_id", F.upper(F.regexp_extract("code", r"(?i)PROGRAM-ID\s*\.\s*([\w-]+)", 1)).alias("program"), clauses.alias("clauses"), records.alias("records"), verbs.alias("verbs"))
    f = cut(f.where(F.size("clauses") > 0))
    s = f.select("source_file", "codebase_id", "program", "records", "verbs", F.explode("clauses").alias("x")).select("source_file", "codebase_id", "program", "records", "verbs", "x.clause", "x.c.*")
    record = F.get(F.filter("records", lambda r: r["file"] == F.col("file")), F.lit(0))["record"]
    s = s.select("*", F.when(F.col("organization") == "INDEXED", "KSDS").when(F.col("organization") == "RELATIVE", "RRDS").alias("kind"), record.alias("record"))
    vs = F.col("kind").isNotNull() | (F.col("organization") == "")
    id_ = F.when(vs, _cb(F.col("file"), "VSAMDataset")).otherwise(_cb(F.col("file"), "Dataset"))
    props = properties(organization=F.coalesce("kind", _none(F.col("organization"))), external_dataset=F.col("external"), access_mode=_none(F.col("access")), record_key=_none(F.col("key")), alternate_keys=F.col("alternate"))
    nodes = s.select(id_.alias("id"), F.when(vs, "VSAMDataset").otherwise("Dataset").alias("type"), F.col("file").alias("name"), "codebase_id", content_hash(F.col("clause")).alias("content_hash"), F.when(F.col("organization") == "", 0.8).otherwise(1.0).alias("parse_confidence"), props.alias("properties"), "source_file")
    mine = F.filter("verbs", lambda v: (v["word"] == F.col("file")) | (v["word"] == F.col("record")))
    used = s.select("codebase_id", "program", id_.alias("file_id"), F.explode(mine).alias("v")).groupBy("codebase_id", "program", "file_id", F.col("v.before").alias("verb"), F.col("v.word").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    edges = used.select(*_edge(_cb(F.col("program"), "Program"), F.col("file_id"), F.when(F.col("verb").isin("WRITE", "REWRITE"), "WRITES").otherwise("READS"), properties(verb=F.col("verb"), count=F.col("n"))))
    return Extract(nodes, edges, s.select(*_unit("file_descriptor", F.col("file"), F.col("clause"), id_)))


def bms(files: DataFrame) -> Extract:
    """Mapsets with their maps and fields, and the maps that programs send and receive."""
    text = F.regexp_replace(F.array_join(F.filter(lines(F.col("text")), lambda x: ~x.startswith("*")), "\n"), r"(?m)^(.{71})\S[ \t]*\n[ \t]{1,15}", "$1")
    f = of_kind(files, "bms").select("source_file", "codebase_id", text.alias("code"))
    name = F.upper(F.regexp_extract("code", r"(?im)^([A-Z][\w$#]*)\s+DFHMSD\b", 1))
    maps = F.transform(_all(F.col("code"), r"(?im)^([A-Z][\w$#]*)\s+DFHMDI\b"), F.upper)
    fields_of = lambda m: _operands(F.regexp_replace(F.regexp_extract(m, r"(?i)^\S*[ \t]+DFHMDF[ \t]+(.*)$", 1), r",[ \t]+(?=[A-Za-z]+=)", ","))  # noqa: E731  # blanks up to the mark of continuation
    bare = lambda ops, k: F.btrim(_keyed(ops, k), F.lit("()"))
    labelled = F.transform(_all(F.col("code"), r"(?im)^((?:[A-Z][\w$#]*)?[ \t]+DFHMDF\b.*)$"), lambda m: F.struct(F.upper(F.regexp_extract(m, r"^([A-Za-z][\w$#]*)", 1)).alias("name"), fields_of(m).alias("o")))
    macro = F.transform(labelled, lambda m: F.struct(
        m["name"].alias("name"), bare(m["o"], "POS").alias("pos"), bare(m["o"], "LENGTH").alias("length"), bare(m["o"], "ATTRB").alias("attrb"), _keyed(m["o"], "INITIAL").alias("initial")))
    f = f.select("source_file", "codebase_id", "code", F.when(name == "", F.upper(stem(F.col("source_file")))).otherwise(name).alias("mapset"), maps.alias("maps"), macro.alias("fields"), F.col("code").rlike(r"(?i)DFHMSD\s+TYPE\s*=\s*FINAL").alias("final_seen"))
    f = cut(f)
    missing = F.exists("fields", lambda x: x["pos"] == "")
    nodes = f.select(*_node("CICSMap", F.col("mapset"), content_hash(F.col("code")), F.when(missing, 0.8).when(~F.col("final_seen"), 0.9).otherwise(1.0), properties(maps=F.col("maps"), fields=F.col("fields"), maps_seen=F.size("maps"), fields_seen=F.size("fields"), final_seen=F.col("final_seen"), anomalies=F.when(missing, F.array(F.lit("missing POS"))))))
    c = of_kind(files, "cics").select("codebase_id", F.upper(F.regexp_extract("text", r"(?i)PROGRAM-ID\.\s*([A-Z0-9-]+)", 1)).alias("program"), F.array_distinct(F.transform(_all(F.col("text"), r"(?i)EXEC\s+CICS\s+(?:SEND|RECEIVE)\s+MAP\s*\(\s*['\"]?([A-Z0-9_]+)['\"]?\s*\)"), F.upper)).alias("maps"))
    edges = c.select("codebase_id", "program", F.explode("maps").alias("m")).select(*_edge(_cb(F.col("program"), "Program"), _cb(F.col("m"), "CICSMap"), "RENDERS_ON"))
    return Extract(nodes, edges, f.select(*_unit("bms_mapset", F.col("mapset"), F.col("code"), _cb(F.col("mapset"), "CICSMap"))))


# ---------------------------------------------------------------- all

#: In order of name: of two extractors that know one id, the later wins.  More can be added.
EXTRACTORS = {"bms": bms, "cobol": cobol, "copybook": copybook, "ddl": ddl, "jcl": jcl, "procedures": procedures, "triggers": triggers, "vsam": vsam}


def extract(files: DataFrame, only: list[str] | None = None) -> Extract:
    """All extractors that handle a file run on it; their rows are united."""
    out = [EXTRACTORS[k](files) for k in sorted(EXTRACTORS) if not only or k in only]
    return Extract(_union([x.nodes for x in out]), _union([x.edges for x in out]), _union([x.units for x in out]))


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """One node per id: real ones before placeholders, then the one of highest confidence, then by content."""
    rank = F.struct("parse_confidence", F.col("content_hash") != "", "content_hash", F.coalesce("properties", F.lit("")))
    rest = [c for c in NODE if c != "id"]
    return nodes.where(F.col("id").isNotNull()).groupBy("id").agg(F.max_by(F.struct(*rest), rank).alias("n")).select("id", "n.*")


def merged_edges(edges: DataFrame) -> DataFrame:
    return edges.where(F.col("src").isNotNull() & F.col("dst").isNotNull()).groupBy("src", "dst", "type").agg(F.min("properties").alias("properties"))


def counts(made: Extract) -> DataFrame:
    """(what, kind, n): rows that the extractors gave, before any are merged."""
    return _union([
        made.nodes.groupBy(F.lit("node").alias("what"), F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n")),
        made.edges.groupBy(F.lit("edge").alias("what"), F.col("type").alias("kind")).agg(F.count(F.lit(1)).alias("n")),
        made.units.groupBy(F.lit("unit").alias("what"), F.col("kind")).agg(F.count(F.lit(1)).alias("n")),
    ])


def unit_tokens(units: DataFrame) -> DataFrame:
    return units.select("kind", token_estimate(F.col("source")).alias("tokens")).groupBy("kind").agg(F.count(F.lit(1)).alias("n_units"), F.sum("tokens").alias("tokens"))
