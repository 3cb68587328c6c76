"""Column functions over identifiers, code, and model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the published rules.
PRIMITIVES = ("boolean", "byte", "char", "double", "float", "int", "long", "short", "void")
PLATFORM_TYPES = ("String", "Integer", "Long", "Double", "Boolean", "Object", "List", "Map", "Set")
CALL_KEYWORDS = ("if", "for", "while", "switch", "catch", "return", "new", "throw", "super", "this", "synchronized", "assert", "else", "do", "try", "case", "default")
BARE_NAMES = ("Helper", "Util", "Utils", "Manager", "Handler", "Service", "Data", "Info", "Impl")


def camel_tokens(name: Column) -> Column:
    """Lower-case parts of an identifier of two letters or more; a run of capitals leaves none."""
    spaced = F.lower(F.regexp_replace(name, "([A-Z])", " $1"))
    return F.filter(F.split(spaced, r"[\s_]+"), lambda x: F.length(x) > 1)


def bare_name(signature: Column) -> Column:
    """The name before the parenthesis, without return type."""
    return F.element_at(F.split(F.trim(F.substring_index(signature, "(", 1)), " "), -1)


def signature_variants(signature: Column) -> Column:
    """The forms under which a signature may be known elsewhere, without repeats."""
    tight = F.regexp_replace(signature, r"\s+", "")
    plain = F.regexp_replace(tight, r"<[^<>]*>", "")
    return F.array_distinct(F.array(signature, tight, plain, F.regexp_replace(plain, r"\.\.\.", "[]"), F.regexp_replace(plain, r"\[\]", "...")))


def base_type(kind: Column) -> Column:
    """A type without generics and dimensions; '' for primitives and the commonest platform types."""
    b = F.trim(F.regexp_replace(F.split_part(kind, F.lit("<"), F.lit(1)), r"[\[\]]", ""))
    return F.when(F.lower(b).isin(*PRIMITIVES) | b.isin(*PLATFORM_TYPES), "").otherwise(b)


def valid_class_name(name: Column) -> Column:
    return name.rlike("^[A-Z][a-zA-Z0-9_]*$") & (F.length(name) >= 3) & ~name.isin(*BARE_NAMES)


def called_names(body: Column) -> Column:
    """Names that stand before a parenthesis, keywords aside, once each."""
    found = F.regexp_extract_all(body, F.lit(r"\b([A-Za-z_]\w*)\s*(?=\()"), 1)
    return F.array_except(found, F.array(*(F.lit(k) for k in CALL_KEYWORDS)))


def tag(text: Column, name: str) -> Column:
    """The trimmed inside of the first <name>...</name>, or null."""
    return F.nullif(F.trim(F.regexp_extract(text, f"(?s)<{name}>(.*?)</{name}>", 1)), F.lit(""))


def clamped(value: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), value))


def strip_declaration(body: Column) -> Column:
    """The text between the first { and the last }, or the body as it is."""
    first = F.instr(body, "{")
    last = F.length(body) - F.instr(F.reverse(body), "}") + 1
    ok = (first > 0) & (F.instr(body, "}") > 0) & (last > first)
    return F.when(ok, F.substring(body, first + 1, last - first - 1)).otherwise(body)


def without_fences(code: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(code, r"(?m)^\s*```.*$\n?", ""), r"(?m)[ \t]+$", ""))


def answer_line(text: Column, key: str) -> Column:
    """What follows KEY: on its line."""
    return F.trim(F.regexp_extract(text, rf"(?m)^\s*{key}:(.*)$", 1))


def truncated(text: Column, most: int) -> Column:
    """At most so many characters, back to the last line end if that is past the half."""
    cut = F.substring(text, 1, most)
    line = F.length(cut) - F.instr(F.reverse(cut), "\n")
    back = (F.instr(cut, "\n") > 0) & (line > most / 2)
    return F.when(F.length(text) <= most, text).when(back, F.substring(cut, F.lit(1), line)).otherwise(cut)


def line_depth(rows: DataFrame, opening: str, closing: str) -> DataFrame:
    """id, line, depth after each line of text (id, text): a running sum over exploded lines."""
    from pyspark.sql import Window

    x = rows.select("id", F.posexplode(F.split("text", "\n")).alias("line", "s"))
    count = lambda c: F.length("s") - F.length(F.replace("s", F.lit(c), F.lit("")))
    w = Window.partitionBy("id").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("id", "line", F.sum(count(opening) - count(closing)).over(w).alias("depth"))


def tfidf(tokens: DataFrame, most_terms: int = 500) -> DataFrame:
    """doc, term, weight: raw counts times ln((1 + n) / (1 + df)) + 1, unit length (doc, term rows).

    Terms beyond the most_terms most frequent are left out (ties by term).
    """
    tf = tokens.groupBy("doc", "term").agg(F.count(F.lit(1)).alias("tf"))
    n = F.broadcast(tokens.agg(F.countDistinct("doc").alias("n")))
    terms = F.broadcast(tf.groupBy("term").agg(F.sum("tf").alias("c"), F.count(F.lit(1)).alias("df")).orderBy(F.desc("c"), "term").limit(most_terms))
    w = tf.join(terms, "term").join(n).select("doc", "term", (F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)).alias("w"))
    norm = w.groupBy("doc").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return w.join(norm, "doc").select("doc", "term", (F.col("w") / F.col("norm")).alias("weight"))


def similar(vectors: DataFrame, least: float = 0.1) -> DataFrame:
    """src < dst with their cosine, where it is least or more; pairs meet in shared terms only."""
    a = vectors.select(F.col("doc").alias("src"), "term", F.col("weight").alias("w1"))
    b = vectors.select(F.col("doc").alias("dst"), "term", F.col("weight").alias("w2"))
    return a.join(b, "term").filter("src < dst").groupBy("src", "dst").agg(F.sum(F.col("w1") * F.col("w2")).alias("weight")).filter(F.col("weight") >= least)


def argument_count(text: Column) -> Column:
    """Arguments in the text between a call's parentheses: commas outside brackets and quotes, plus one.

    A fold over characters with the state (depth, the open quote, whether escaped, commas); blank: 0.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("quote"), F.lit(False).alias("escaped"), F.lit(0).alias("n"))

    def step(s, c):
        quoted = s["quote"] != ""
        quote = F.when(quoted & ~s["escaped"] & (c == s["quote"]), "").when(~quoted & c.isin('"', "'"), c).otherwise(s["quote"])
        depth = F.when(quoted, s["depth"]).when(c.isin("(", "[", "{", "<"), s["depth"] + 1).when(c.isin(")", "]", "}", ">"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        return F.struct(depth.alias("depth"), quote.alias("quote"), (quoted & ~s["escaped"] & (c == "\\")).alias("escaped"), (s["n"] + (~quoted & (s["depth"] == 0) & (c == ",")).cast("int")).alias("n"))

    return F.when(F.trim(text) == "", 0).otherwise(F.aggregate(F.split(text, ""), start, step, lambda s: s["n"] + 1))


def inner_types(source: Column, outer: Column) -> Column:
    """Names of types declared in a source, comments and strings aside, other than the outer one."""
    plain = F.regexp_replace(F.regexp_replace(F.regexp_replace(source, r"(?s)/\*.*?\*/", " "), r"//[^\n]*", " "), r'"(\\.|[^"\\])*"', '""')
    return F.array_distinct(F.array_remove(F.regexp_extract_all(plain, F.lit(r"\b(?:class|interface|enum|record)\s+([A-Z]\w*)"), 1), outer))


def verdict(text: Column) -> Column:
    """valid, confidence (0.5 if unreadable, 0 if absent), reasoning, modifications of a line-keyed answer."""
    line = F.regexp_extract(text, r"(?m)^\s*CONFIDENCE:(.*)$", 1)
    has = text.rlike(r"(?m)^\s*CONFIDENCE:")
    mods = answer_line(text, "MODIFICATIONS")
    return F.struct(
        F.lower(answer_line(text, "VALID")).contains("yes").alias("valid"),
        F.when(has, F.coalesce(F.trim(line).try_cast("double"), F.lit(0.5))).otherwise(0.0).alias("confidence"),
        F.regexp_extract(text, r"(?s)REASONING:\s*(.*?)\s*(?:MODIFICATIONS:|\z)", 1).alias("reasoning"),
        F.when((mods == "") | (F.lower(mods) == "none"), F.array().cast("array<string>")).otherwise(F.transform(F.split(mods, ","), lambda m: F.trim(m))).alias("modifications"),
    )


def suggestion(text: Column) -> Column:
    """class_name, rationale and confidence (0 to 1, null if none is given) of an answer, or null: both texts
    must be there and the name a valid one."""
    name, why = tag(text, "class_name"), tag(text, "rationale")
    sure = clamped(tag(text, "confidence").try_cast("double"))
    known = F.when(tag(text, "confidence").try_cast("double").isNotNull(), sure)
    return F.when(name.isNotNull() & why.isNotNull() & valid_class_name(name), F.struct(name.alias("class_name"), why.alias("rationale"), known.alias("confidence")))


def listed(text: Column, name: str) -> Column:
    """The entries of the comma list in <name>, trimmed, without empty ones."""
    parts = F.transform(F.split(F.coalesce(tag(text, name), F.lit("")), ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def suggestions(text: Column) -> Column:
    """The insides of all <suggestion> blocks of an answer."""
    return F.regexp_extract_all(text, F.lit(r"(?s)<suggestion>(.*?)</suggestion>"), 1)


def split_parameters(text: Column) -> Column:
    """The parts of a parameter list between commas outside <...>, as they stand; a part after the last comma only if not empty."""
    start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("part"), F.array().cast("array<string>").alias("done"))

    def step(s, c):
        cut = (c == ",") & (s["depth"] == 0)
        depth = s["depth"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)
        done = F.when(cut, F.concat(s["done"], F.array(s["part"]))).otherwise(s["done"])
        return F.struct(depth.alias("depth"), F.when(cut, "").otherwise(F.concat(s["part"], c)).alias("part"), done.alias("done"))

    return F.aggregate(F.split(F.coalesce(text, F.lit("")), ""), start, step, lambda s: F.when(s["part"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["part"]))))


def parameter_type(parameter: Column) -> Column:
    """The type of one parameter such as "final List<String> items": annotations and final or var go, a
    variable number becomes [], and what stands before the last space outside <...> is the type; if
    there is none, all of it. Spaces after commas go."""
    p = F.regexp_replace(F.regexp_replace(F.trim(parameter), r"^(@\w+\s+)*", ""), r"^(final|var)\s+", "")
    many = F.when(p.contains("..."), "[]").otherwise("")
    p = F.replace(p, F.lit("..."), F.lit(""))
    # from the right: the first space at depth 0 (found: its place from the end, 0 none yet)
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("seen"), F.lit(0).alias("found"))

    def step(s, c):
        depth = s["depth"] + F.when(c == ">", 1).when(c == "<", -1).otherwise(0)
        found = F.when((s["found"] == 0) & (s["depth"] == 0) & c.rlike(r"^\s$"), s["seen"] + 1).otherwise(s["found"])
        return F.struct(depth.alias("depth"), (s["seen"] + 1).alias("seen"), found.alias("found"))

    back = F.aggregate(F.split(F.reverse(p), ""), start, step, lambda s: s["found"])
    before = F.trim(F.substring(p, F.lit(1), F.length(p) - back))
    kind = F.when((back > 0) & (back < F.length(p)), before).otherwise(p)
    return F.regexp_replace(F.concat(kind, many), r",\s+", ",")


def parameter_types(text: Column) -> Column:
    """The types of a parameter list, in order; blank parts are none."""
    return F.transform(F.filter(split_parameters(text), lambda x: F.trim(x) != ""), parameter_type)
