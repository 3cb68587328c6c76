"""Column functions over Java sources and file names: project types, summaries, tests, stubs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftline.functions.text import PRIMITIVES

#: Names that are not types of a project, by package.
PLATFORM = {
    "java.lang": "String Object Integer Long Short Byte Float Double Boolean Character Void Number Math Class System Thread Throwable Exception RuntimeException Error Enum StringBuilder StringBuffer Comparable Comparator Iterable AutoCloseable Cloneable Appendable CharSequence Readable",
    "java.util": "List Map Set Collection Iterator Queue Deque ArrayList HashMap HashSet LinkedList TreeMap TreeSet LinkedHashMap LinkedHashSet Collections Arrays Objects Optional Stream Properties Date Calendar UUID Locale Random Scanner Timer BitSet",
    "java.util.function": "Consumer Supplier Function Predicate BiFunction BiConsumer BiPredicate UnaryOperator BinaryOperator",
    "java.io": "File InputStream OutputStream Reader Writer BufferedReader BufferedWriter BufferedInputStream BufferedOutputStream FileInputStream FileOutputStream FileReader FileWriter InputStreamReader OutputStreamWriter PrintStream PrintWriter Closeable Serializable Flushable ByteArrayInputStream ByteArrayOutputStream StringReader StringWriter",
    "java.nio": "ByteBuffer CharBuffer Path Paths Files Channel ReadableByteChannel WritableByteChannel Charset StandardCharsets",
    "java.net": "URL URI Socket ServerSocket URLConnection",
    "parameters": "T E K V R S U",
}
#: Names for which no stub is made.
COMMON = "String Integer Long Double Float Boolean Byte Short Character Object Class Exception RuntimeException Throwable Error List ArrayList LinkedList Set HashSet TreeSet Map HashMap TreeMap Collection Collections Arrays Iterator Iterable BigDecimal BigInteger Date LocalDate LocalDateTime LocalTime Optional Stream Collectors Function Consumer Supplier Predicate StringBuilder StringBuffer System Math Random Override Deprecated SuppressWarnings FunctionalInterface Logger ChronoUnit".split()
#: Where a code names a class, and how a test method looks.
USED = (r"\b([A-Z][a-zA-Z0-9]*+)\s*(?:\(|[a-z]|\s*=)", r"<\s*([A-Z][a-zA-Z0-9]*)")
TEST = r"@Test[^{]*?(?:public|protected|private)?\s+(?:static\s+)?void\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+\w+(?:\s*,\s*\w+)*)?\s*\{([^}]*(?:\{[^}]*\}[^}]*)*)\}"


def is_project_type(name: Column) -> Column:
    """Whether a base type may be one of the project, where its types are not listed; null and '' are not.
    (Where they are, join with the list.)"""
    known = [n for names in PLATFORM.values() for n in names.split()]
    return F.coalesce((name != "") & ~name.isin(*PRIMITIVES, *known), F.lit(False))


def javadoc_summary(source: Column, name: Column) -> Column:
    """The first sentence of the documentation comment right before the declaration of a method, or null.

    Annotations (with arguments that hold no parenthesis) and modifiers may stand between the two.
    """
    block = r"(/\*\*[^*]*+(?:\*(?!/)[^*]*+)*+\*/)"
    marks = r"\s*(?:@\w+(?:\([^()]*\))?\s*)*(?:(?:public|protected|private|static|final|abstract|synchronized|native|strictfp|default)\s+)*(?:<[^()]*>\s*)?[\w<>\[\],.? ]+\s+"
    pattern = F.concat(F.lit(f"{block}{marks}\\Q"), name, F.lit("\\E\\("))
    found = F.call_function("regexp_extract", source, pattern, F.lit(1))
    inner = F.regexp_replace(F.regexp_replace(found, r"/\*\*|\*/", ""), r"(?m)^\s*\*", "")
    words = F.trim(F.regexp_replace(inner, r"\s+", " "))
    first = F.split(words, r"\.\s")[0]
    return F.when((found != "") & (first != ""), F.when(first.endswith("."), first).otherwise(F.concat(first, F.lit("."))))


def test_methods(source: Column) -> Column:
    """array<struct<name, body>> of the methods under @Test. A body ends at its first closing brace, as published."""
    names, bodies = (F.regexp_extract_all(source, F.lit(TEST), k) for k in (1, 2))
    return F.zip_with(names, bodies, lambda n, b: F.struct(n.alias("name"), b.alias("body")))


def qualified_name(source: Column, path: Column) -> Column:
    """The class name that a file stands for: its package and its own name without ending."""
    package = F.regexp_extract(source, r"package\s+([\w.]+)\s*;", 1)
    stem = F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    return F.when(package == "", stem).otherwise(F.concat_ws(".", package, stem))


def missing_types(code: Column, existing: Column) -> Column:
    """Sorted names that a code uses as classes and that neither exist (an array) nor are common; no
    constants (no small letter) and none of two letters or fewer. Names are taken whole."""
    found = F.concat(*(F.regexp_extract_all(code, F.lit(p), 1) for p in USED))
    known = F.concat(existing, F.array(*(F.lit(c) for c in COMMON)))
    return F.array_sort(F.filter(F.array_except(F.array_distinct(found), known), lambda n: (F.length(n) > 2) & (n != F.upper(n))))


def stub(name: Column, package: Column) -> Column:
    """A class of that name that compiles and does nothing."""
    head = F.when(F.coalesce(package, F.lit("")) == "", "").otherwise(F.concat(F.lit("package "), package, F.lit(";\n")))
    return F.concat(head, F.lit("\n/** Stands in for a class that is not here. */\npublic class "), name, F.lit(" {\n    public "), name, F.lit("() {}\n    public Object get"), name, F.lit("() { return this; }\n}\n"))
