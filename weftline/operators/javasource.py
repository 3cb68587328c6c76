"""Java sources as relations: tokens, blocks, declarations, members, calls and field accesses.

A source is split into tokens by one pattern that covers every character, so offsets and lines are
running sums. Texts are dealt by file before they are cut, so tokens are never shuffled. Braces give each token its depth; within (file, depth) the last opening brace is the
block that holds it. In a block, nested blocks count as one token, so its parts between ``;`` and
closing braces are its declarations, whatever they hold. All of it is windows by file and regular
expressions over header texts: no step leaves the JVM, and no step looks at two files at once.

sources has one row a file (file, source). Files without a class give no rows; broken files give the
declarations that can be told. Null and empty sources give none. Generic types may nest five deep.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.functions.text import CALL_KEYWORDS, argument_count
from weftline.operators.lineage import cut

#: Comments, text blocks, strings, characters, names, numbers, space, any other character.
TOKEN = r'//[^\n]*|/\*[\s\S]*?\*/|"""[\s\S]*?"""|"[^"\\\n]*+(?:\\.[^"\\\n]*+)*+"|' + r"'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|[\p{L}_$][\p{L}\p{N}_$]*|\d[\w.]*|\s+|->|[\s\S]"
NAME = r"[\p{L}_$][\p{L}\p{N}_$]*"
#: Fixed values of the language.
MODIFIERS = "public|protected|private|static|abstract|final|native|synchronized|transient|volatile|strictfp|default|sealed"
TYPE_WORDS = ("class", "interface", "enum", "record")
_GENERIC = r"<(?:[^<>]|<(?:[^<>]|<(?:[^<>]|<(?:[^<>]|<[^<>]*>)*>)*>)*>)*>"
_ANNOTATION = rf"@ (?!interface\b){NAME}(?: \. {NAME})*(?: \( [^()]*\))?"

#: What may stand before a declaration.
_LEAD = rf"^(?:(?:{_ANNOTATION}|non - sealed|(?:{MODIFIERS})(?= )) ?)+"


#: Characters of source in a task: their tokens are some hundred times as large.
TASK_CHARS = 2 << 20


def _dealt(sources: DataFrame) -> DataFrame:
    """sources dealt by file into as many parts as their length asks for; windows by file keep to them."""
    n = sources.agg(F.sum(F.length("source").cast("long"))).first()[0] or 0
    return sources.repartition(max(sources.sparkSession.sparkContext.defaultParallelism, n // TASK_CHARS + 1), "file")


def tokens(sources: DataFrame) -> DataFrame:
    """file, pos, tok, at (offset from 0), line (from 1) of all tokens but space and comments."""
    found = _dealt(sources.filter("source is not null").select("file", "source")).select("file", F.posexplode(F.regexp_extract_all("source", F.lit(TOKEN), 0)).alias("pos", "tok"))
    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    lines = F.length("tok") - F.length(F.replace("tok", F.lit("\n"), F.lit("")))
    placed = found.withColumn("at", F.coalesce(F.sum(F.length("tok")).over(before), F.lit(0))).withColumn("line", 1 + F.coalesce(F.sum(lines).over(before), F.lit(0)))
    return placed.filter(~F.col("tok").rlike(r"^(?:\s|//|/\*)"))


def blocks(found: DataFrame) -> DataFrame:
    """tokens with block (the brace that holds them), inner (the brace's own block for { and its match for }),
    depth of parentheses within the block, and seg, the declaration of the block that they are in.

    The file itself is block -1. A brace stands in its outer block.
    """
    by_file = Window.partitionBy("file").orderBy("pos")
    upto = by_file.rowsBetween(Window.unboundedPreceding, 0)
    is_open, is_close = F.col("tok") == "{", F.col("tok") == "}"
    t = found.withColumn("d", F.sum(is_open.cast("int") - is_close.cast("int")).over(upto) - is_open.cast("int"))
    t = t.withColumn("after", F.lead("tok").over(by_file)).withColumn("before", F.lag("tok").over(by_file))
    # a brace ends its outer row at depth d and its inner one at d + 1
    role = F.when(is_open | is_close, F.array(F.lit("outer"), F.lit("inner"))).otherwise(F.array(F.lit("token")))
    rows = t.withColumn("role", F.explode(role)).withColumn("d", F.col("d") + (F.col("role") == "inner").cast("int"))
    level = Window.partitionBy("file", "d").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = F.coalesce(F.last(F.when((F.col("role") == "inner") & is_open, F.col("pos")), ignorenulls=True).over(level), F.lit(-1))
    rows = rows.withColumn("block", last)
    own = Window.partitionBy("file", "pos")
    rows = rows.withColumn("inner", F.max(F.when(F.col("role") == "inner", F.col("block"))).over(own)).filter("role <> 'inner'").drop("role", "d")
    inside = Window.partitionBy("file", "block").orderBy("pos")
    opens, closes = (F.col("tok") == "(").cast("int"), (F.col("tok") == ")").cast("int")
    rows = rows.withColumn("p", F.sum(opens - closes).over(inside.rowsBetween(Window.unboundedPreceding, 0)) - opens)
    ends = (F.col("p") == 0) & ((F.col("tok") == ";") | (is_close & ~F.coalesce(F.col("after"), F.lit("")).isin(",", ";", ".", ")")))
    return rows.withColumn("seg", F.coalesce(F.sum(ends.cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))


def _erased(text: Column) -> Column:
    for _ in range(5):
        text = F.regexp_replace(text, " <[^<>]*>", "")
    return text


def _tight(text: Column) -> Column:
    """A type's text without the spaces between its tokens, but for those between words."""
    return F.regexp_replace(F.regexp_replace(text, r" ?([^\p{L}\p{N}_$ ]) ?", "$1"), " +", " ")


def declarations(rows: DataFrame) -> DataFrame:
    """Each declaration with its header (tokens to the first {, = or ;), whole (all its tokens outside
    parentheses), body block, places, and what it declares: type, anonymous, callable, field or other;
    and of its tokens the blocks of anonymous classes and the ends (inner, pos) of blocks."""
    top = (F.col("p") == 0) | ((F.col("p") == 1) & ~F.col("tok").isin("(", ")"))  # what stands in one pair of parentheses
    shown = F.when(F.col("tok").rlike("^[\"']"), F.lit('""')).otherwise(F.col("tok"))
    item = F.struct("pos", shown.alias("tok"), "p")
    first_stop = F.min(F.when((F.col("p") == 0) & F.col("tok").isin("{", "=", ";"), F.col("pos"))).over(Window.partitionBy("file", "block", "seg"))
    new_at = F.max(F.when(F.col("tok") == "new", F.col("p"))).over(Window.partitionBy("file", "block", "seg", "p").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    unnamed = (F.col("tok") == "{") & (F.col("before") == ")") & new_at.isNotNull()
    x = rows.withColumn("unnamed", F.when(unnamed, F.col("inner"))).withColumn("stop", first_stop)
    seg = x.groupBy("file", "block", "seg").agg(
        F.array_sort(F.collect_list(F.when(top & (F.col("pos") < F.coalesce(F.col("stop"), F.lit(1 << 40))), item))).alias("h"),
        F.array_sort(F.collect_list(F.when(F.col("p") == 0, item))).alias("w"),
        F.min_by("tok", F.when(F.col("pos") == F.col("stop"), 0)).alias("ending"),
        F.min(F.when((F.col("tok") == "{") & (F.col("pos") == F.col("stop")), F.col("inner"))).alias("body_block"),
        F.min("at").alias("at"), F.min("line").alias("line"), F.max(F.struct("pos", F.col("at") + F.length("tok"), "line")).alias("z"),
        F.collect_list("unnamed").alias("anonymous"), F.collect_list(F.when(F.col("tok") == "}", F.struct("inner", "pos"))).alias("closed"),
    )
    text = lambda c: F.array_join(F.transform(c, lambda t: t["tok"]), " ")
    seg = seg.select("file", "block", "seg", text("h").alias("header"), text("w").alias("whole"), "ending", "body_block", "at", F.col("z.col2").alias("end_at"), "line", F.col("z.line").alias("end_line"), "anonymous", "closed")
    marks = F.regexp_extract_all(F.regexp_extract("header", _LEAD, 0), F.lit(rf"{_ANNOTATION}|[\w-]+(?: - \w+)?"), 0)
    plain = F.regexp_replace("header", _LEAD, "")
    bare = _erased(F.concat(F.lit(" "), plain))
    kind = (
        F.when(plain.rlike(rf"^(?:@ )?(?:class|interface|enum) {NAME}") | plain.rlike(rf"^record {NAME}(?: <.*>)? \("), "type")
        .when(bare.rlike(rf"(?:^| ){NAME} \([^()]*\)") & F.col("ending").isin("{", ";"), "callable")
        .when(bare.rlike(rf"^ {NAME}(?: [.\[\]]| {NAME})* {NAME}") & F.coalesce(F.col("ending"), F.lit(";")).isin("=", ";"), "field")
        .otherwise("other")
    )
    return seg.withColumn("plain", plain).withColumn("kind", kind).withColumn("modifiers", F.transform(marks, lambda m: F.regexp_replace(F.regexp_replace(m, r" \(.*", ""), " ", "")))


def types(rows: DataFrame | None, declared: DataFrame) -> DataFrame:
    """file, block, name, kind, package, extends, implements, modifiers, lines of the types; anonymous
    classes have a block and no name. order 0 is the first class of the file, which is the file's class.
    The declarations hold all that is needed; rows are not read again and may be None."""
    d = declared.filter("kind = 'type'")
    head = F.regexp_replace(F.regexp_replace("plain", "^@ ", ""), rf"^(\w+ {NAME}) {_GENERIC}", "$1")
    word = F.split_part(head, F.lit(" "), F.lit(1))
    clause = lambda a, stop: F.regexp_extract(head, rf" {a} (.*?)(?= (?:{stop}) |$)", 1)
    listed = F.filter(F.transform(F.split(_erased(F.concat(F.lit(" "), clause("implements", "permits"))), ","), _tight), lambda t: F.trim(t) != "")
    named = d.select(
        "file", F.col("body_block").alias("block"), word.alias("word"), F.split_part(head, F.lit(" "), F.lit(2)).alias("type_name"), "modifiers",
        F.nullif(_tight(clause("extends", "implements|permits")), F.lit("")).alias("extends"), F.transform(listed, lambda t: F.trim(t)).alias("implements"), "line", "end_line",
    ).filter("block is not null")
    anonymous = declared.select("file", F.explode("anonymous").alias("block"), F.lit("anonymous").alias("word"))
    package = declared.filter("block = -1 and header like 'package %'").groupBy("file").agg(F.first(F.regexp_replace("header", "^package | ", "")).alias("package"))
    order = Window.partitionBy("file").orderBy(F.when(F.col("word") == "class", F.col("block")).asc_nulls_last())
    return named.unionByName(anonymous, allowMissingColumns=True).join(package.hint("merge"), "file", "left").withColumn("package", F.coalesce("package", F.lit(""))).withColumn("order", F.when(F.col("word") == "class", F.row_number().over(order) - 1))


def _parameters(text: Column) -> Column:
    """array<struct<name, type>> of a parameter list: generics erased, varargs as []."""
    parts = F.filter(F.split(_erased(F.concat(F.lit(" "), text)), ","), lambda x: F.trim(x) != "")

    def one(x):
        y = F.trim(F.regexp_replace(F.regexp_replace(F.trim(x), rf"@ {NAME}(?: \. {NAME})* ", ""), r"^final ", ""))
        name = F.regexp_extract(y, rf"({NAME})(?: \[ \])*$", 1)
        kind = F.regexp_replace(F.regexp_replace(y, rf" {NAME}(?: \[ \])*$", ""), r" ?\. \. \.", "[]")
        return F.struct(name.alias("name"), F.regexp_replace(kind, " ", "").alias("type"))

    return F.transform(parts, one)


def members(sources: DataFrame, inner: bool = True) -> DataFrame:
    """The fields, methods and constructors of each file's first class, with their places.

    file, package, class_name, owner (the type that declares it, null if anonymous), kind, name,
    signature (method(type,...); <init>(...) for constructors; a field's name), type (of the field, or
    returned), modifiers, parameters, line, end_line, body (the declaration's own text).
    inner: with the members of types within the class (local and anonymous ones, too), else its own only.
    """
    declared = cut(declarations(blocks(tokens(sources))))  # read several times below
    known = types(None, declared)
    first = known.filter("order = 0").select("file", F.col("block").alias("from_at"), "package", F.col("type_name").alias("class_name"), F.col("extends"), "implements")
    ends = declared.select("file", F.explode("closed").alias("e")).select("file", F.col("e.inner").alias("from_at"), F.col("e.pos").alias("to_at"))
    scope = first.join(ends.hint("merge"), ["file", "from_at"], "left").withColumn("to_at", F.coalesce("to_at", F.lit(1 << 40)))
    near = (F.col("t.block") >= F.col("s.from_at")) & (F.col("t.block") <= F.col("s.to_at")) if inner else F.col("t.block") == F.col("s.from_at")
    own = known.alias("t").join(scope.hint("merge").alias("s"), (F.col("t.file") == F.col("s.file")) & near).select("t.file", "t.block", "t.word", F.col("t.type_name").alias("owner"), "s.package", "s.class_name")
    d = declared.filter("kind in ('callable', 'field')").join(own.hint("merge"), ["file", "block"]).filter("not (word = 'enum' and seg = 0)")
    head = F.regexp_replace("plain", rf"^{_GENERIC} ", "")
    call = rf"^(.*?) ?({NAME}) \( ?([^()]*)\)"
    params = _parameters(F.regexp_extract(head, call, 3))
    returned, name = _tight(F.trim(F.regexp_extract(head, call, 1))), F.regexp_extract(head, call, 2)
    made = (returned == "") & (F.coalesce(F.col("owner") == name, F.lit(False)))
    shape = F.concat(F.when(made, "<init>").otherwise(name), F.lit("("), F.array_join(F.transform(params, lambda p: p["type"]), ","), F.lit(")"))
    out = ["file", "package", "class_name", "owner"]
    place = ["line", "end_line", "at", "end_at"]
    calls = d.filter("kind = 'callable'").select(*out, F.when(made, "constructor").otherwise("method").alias("kind"), name.alias("name"), shape.alias("signature"), F.when(made, "").otherwise(returned).alias("type"), "modifiers", params.alias("parameters"), *place)
    calls = calls.filter("type <> '' or kind = 'constructor'")
    lead = rf"^(?:(?:{_ANNOTATION}|(?:{MODIFIERS})(?= )) ?)+"
    bare = F.regexp_replace(_erased(F.concat(F.lit(" "), F.regexp_replace(F.regexp_replace("whole", lead, ""), r" ;$", ""))), r" = [^,]*", "")
    parts = F.transform(F.split(F.trim(bare), " ?, ?"), lambda x: F.trim(x))
    first_name = F.regexp_extract(parts[0], rf"({NAME})(?: \[ \])*$", 1)
    full = F.expr(r"regexp_extract(plain, concat('^(.*?) \\Q', first_name, '\\E(?: |$)'), 1)")
    names = F.transform(F.concat(F.array(F.col("first_name")), F.slice(F.col("parts"), 2, 1 << 20)), lambda x: F.regexp_extract(x, rf"^({NAME})", 1))
    fields = d.filter("kind = 'field'").withColumn("parts", parts).withColumn("first_name", first_name).withColumn("type", _tight(full)).withColumn("name", F.explode(names)).filter("name <> ''")
    fields = fields.select(*out, F.lit("field").alias("kind"), "name", F.col("name").alias("signature"), "type", "modifiers", F.lit(None).cast("array<struct<name:string,type:string>>").alias("parameters"), *place)
    # merged: a table's size on disk says little of that of its texts, and the driver would hold a broadcast
    both = calls.unionByName(fields).join(sources.select("file", "source").hint("merge"), "file")
    body = F.substring(F.col("source"), F.col("at") + 1, F.col("end_at") - F.col("at"))
    return cut(both.select(*out, "kind", "name", "signature", "type", "modifiers", "parameters", "line", "end_line", body.alias("body")))


def _blocks_of(bodies: DataFrame) -> DataFrame:
    """file (file and signature), source: the bodies from their first brace; those without one have none."""
    return bodies.filter(F.instr("body", "{") > 0).select(F.struct("file", "signature").alias("file"), F.substring(F.col("body"), F.instr("body", "{"), F.length("body")).alias("source"))


def calls(bodies: DataFrame) -> DataFrame:
    """file, signature, place, name, argc of the calls in bodies (file, signature, body), outer and inner
    ones: a name before a parenthesis, keywords and created types aside, and what stands between the two."""
    own = _blocks_of(bodies)
    found = tokens(own)
    by = Window.partitionBy("file").orderBy("pos")
    is_open = F.col("tok") == "("
    depth = F.sum(is_open.cast("int") - (F.col("tok") == ")").cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)) - is_open.cast("int")
    t = found.withColumn("d", depth).withColumn("name", F.lag("tok").over(by)).withColumn("maker", F.lag("tok", 2).over(by))
    level = Window.partitionBy("file", "d").orderBy("pos").rowsBetween(1, Window.unboundedFollowing)
    t = t.withColumn("close", F.first(F.when(F.col("tok") == ")", F.col("at")), ignorenulls=True).over(level))
    named = t.filter(is_open & F.col("name").rlike(rf"^{NAME}$") & ~F.col("name").isin(*CALL_KEYWORDS) & (F.coalesce("maker", F.lit("")) != "new"))
    inside = F.substring(F.col("source"), F.col("at") + 2, F.col("close") - F.col("at") - 1)
    joined = named.join(own.hint("merge"), "file")
    return joined.select("file.file", "file.signature", F.col("at").alias("place"), "name", F.when(F.col("close").isNotNull(), argument_count(inside)).alias("argc"))


def accesses(bodies: DataFrame, fields: DataFrame) -> DataFrame:
    """file, signature, field: names in bodies (file, signature, body) that are fields (file, name) of the file."""
    own = _blocks_of(bodies)
    used = tokens(own).filter(F.col("tok").rlike(rf"^{NAME}$")).select("file.file", "file.signature", F.col("tok").alias("name")).distinct()
    return used.join(fields.select("file", "name").distinct().hint("merge"), ["file", "name"]).select("file", "signature", F.col("name").alias("field"))


def internal_calls(found: DataFrame, methods: DataFrame) -> DataFrame:
    """file, signature, target, place: calls (of ``calls``) to names of methods (file, name, signature,
    n_params) of the file: the signature, where one method alone has the name and number of arguments,
    else the name; each target once, at its first place."""
    names = methods.select("file", "name").distinct()
    unique = methods.groupBy("file", "name", F.col("n_params").alias("argc")).agg(F.count(F.lit(1)).alias("n"), F.min("signature").alias("to")).filter("n = 1").drop("n")
    own = found.join(names.hint("merge"), ["file", "name"]).join(unique.hint("merge"), ["file", "name", "argc"], "left")
    return own.groupBy("file", "signature", F.coalesce("to", "name").alias("target")).agg(F.min("place").alias("place"))


def parse_counts(sources: DataFrame, found: DataFrame) -> DataFrame:
    """files, parsed, failed, rate: how many sources have a class with members."""
    have = found.select("file").distinct().withColumn("ok", F.lit(1))
    joined = sources.select("file").join(have.hint("merge"), "file", "left")
    n = joined.agg(F.count(F.lit(1)).alias("files"), F.count("ok").alias("parsed"))
    return n.select("files", "parsed", (F.col("files") - F.col("parsed")).alias("failed"), F.when(F.col("files") > 0, F.col("parsed") / F.col("files")).alias("rate"))
