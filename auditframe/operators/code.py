"""Facts from source files: imports, embedded SQL, database calls, classes.

A file is one row, so every fact is an array computed in that row, in one scan
and without a shuffle (:func:`code_facts`). The flat tables explode it.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditframe import vocab
from auditframe.functions.columns import all_groups, first_group, let, strip
from auditframe.functions.paths import detect_language, extension, file_name
from auditframe.functions.sqltext import query_type
from auditframe.sources.files import scan_source_files

_IMPORT = "array<struct<kind: string, module: string, name: string>>"
_SQL = "array<struct<query: string, line: int, type: string, table: string>>"
_CALL = "array<struct<name: string, line: int>>"
_CLASS = "array<struct<name: string, bases: array<string>>>"
_NAMES = "array<string>"

_JAVASCRIPT = ("javascript", "typescript")
_CASELESS = "(?idU)"
_EXACT = "(?dU)"


def _empty(kind: str) -> Column:
    return F.array().cast(kind)


def _numbered_lines(content: Column, keep: Callable[[Column], Column]) -> Column:
    """Lines for which ``keep`` holds, as ``array<struct<t, i>>`` with numbers from 1."""
    lines = F.transform(F.split(content, "\n", -1), lambda t, i: F.struct(t.alias("t"), (i + 1).alias("i")))
    return F.filter(lines, lambda s: keep(s["t"]))


def _by_language(language: Column, choices: Mapping[str, Column], otherwise: Column) -> Column:
    """The entry for a file's language; TypeScript goes with JavaScript."""
    chain = None
    for name, value in choices.items():
        match = language.isin(*_JAVASCRIPT) if name == "javascript" else language == name
        chain = F.when(match, value) if chain is None else chain.when(match, value)
    return chain.otherwise(otherwise)


def sql_occurrences(content: Column, language: Column, whole_words: bool = True, ddl_tables: bool = False) -> Column:
    """Embedded SQL per file as ``array<struct<query, line, type, table>>``.

    At most one string per line and kind of quoting; which lines are looked at
    and how a string is found depends on the language. ``whole_words=False``
    also looks at lines where a keyword is part of a longer word ("selected"); ``ddl_tables=True`` also takes the name after
    TABLE for the table, as in CREATE TABLE and DROP TABLE.
    """
    def like(line: Column, gate: str) -> Column:
        return F.rlike(line, F.lit(_CASELESS + (gate if whole_words else gate.replace(r"\b", ""))))

    def gate(line: Column) -> Column:
        code = like(line, vocab.CODE_SQL_GATE)
        choices = {
            "python": like(line, vocab.PYTHON_SQL_GATE), "java": like(line, vocab.JAVA_SQL_GATE),
            "javascript": code, "csharp": code, "php": code,
        }
        return _by_language(language, choices, like(line, vocab.GENERIC_SQL_GATE))

    def strings(line: Column) -> Column:
        plain = first_group(line, _CASELESS + vocab.CODE_SQL_STRING)
        template = first_group(line, _CASELESS + vocab.CODE_SQL_TEMPLATE)
        called = first_group(line, _EXACT + vocab.PYTHON_SQL_EXECUTE)
        choices = {
            "python": F.array(F.coalesce(called, first_group(line, _EXACT + vocab.PYTHON_SQL_STRING))),
            "java": F.array(first_group(line, _CASELESS + vocab.JAVA_SQL_STRING)),
            "javascript": F.array(plain, template),
            "csharp": F.array(first_group(line, _CASELESS + vocab.CSHARP_SQL_STRING)),
            "php": F.array(plain),
        }
        return F.array_compact(_by_language(language, choices, F.array(F.coalesce(plain, template))))

    def row(query: Column, line: Column) -> Column:
        script = language.isin("python", "java")
        kind = F.when(script, query_type(query, vocab.STATEMENT_TYPES, "prefix", None)).otherwise(
            query_type(query, vocab.CONTAINED_TYPES, "contains", None)
        )
        after_into = first_group(query, _CASELESS + vocab.TABLE_AFTER_INTO)
        after_update = first_group(query, _CASELESS + vocab.TABLE_AFTER_UPDATE)
        table = F.coalesce(
            first_group(query, _CASELESS + vocab.TABLE_AFTER_FROM),
            F.when(script | language.isin(*_JAVASCRIPT), after_into),
            F.when(script, after_update),
            *([first_group(query, _CASELESS + vocab.TABLE_AFTER_TABLE)] if ddl_tables else []),
        )
        return F.struct(
            strip(query).alias("query"), line.alias("line"), kind.alias("type"), table.alias("table")
        )

    def of_line(s: Column) -> Column:
        return F.transform(strings(s["t"]), lambda q: row(q, s["i"]))

    found = F.flatten(F.transform(_numbered_lines(content, gate), of_line))
    return F.when(language == "sql", _empty(_SQL)).otherwise(found.cast(_SQL))


# Python strings and comments. Possessive groups loop where greedy ones recurse, so long strings are safe.
_TRIPLE = r'"""(?:[^"\\]|\\[\s\S]|"(?!""))*+"""|' + r"'''(?:[^'\\]|\\[\s\S]|'(?!''))*+'''"
_SHORT = r'"(?:[^"\\\n]|\\[\s\S])*+"|' + r"'(?:[^'\\\n]|\\[\s\S])*+'"


def _replacement_field() -> str:
    """An expression in braces, with strings and braces inside; group 1 is the expression, empty for doubled braces."""
    body = ""
    for _ in range(3):
        nested = r"|\{(?:" + body + r")*+\}" if body else ""
        body = rf"[^{{}}'\"]++|{_TRIPLE}|{_SHORT}{nested}"
    return rf"\{{\{{|\}}\}}|\{{((?:{body})*+)\}}"


_FIELD = _replacement_field()
_INSIDE = _FIELD.replace("((?:", "(?:(?:")
#: Formatted strings first, whose fields may hold the quotes that end other strings.
_PYTHON_TOKEN = (
    r"""(?=["'#fFrR])(?:"""
    rf'(?<!\w)(?i:fr?|rf)(?:"""(?:[^"\\{{}}]|\\[\s\S]|"(?!"")|{_INSIDE})*+"""|'
    rf"'''(?:[^'\\{{}}]|\\[\s\S]|'(?!'')|{_INSIDE})*+'''|"
    rf'"(?!"")(?:[^"\\\n{{}}]|\\[\s\S]|{_INSIDE})*+"|'
    rf"'(?!'')(?:[^'\\\n{{}}]|\\[\s\S]|{_INSIDE})*+')|"
    rf"{_TRIPLE}|{_SHORT}|#[^\n]*+)"
)
#: Formatted strings inside the fields of others are followed so deep.
_FORMAT_DEPTH = 3


def _joined(text: Column, pattern: str, body: Callable[[Column, Column], Column], group: int) -> Column:
    """The text between matches of ``pattern``, and the matches, each pair through ``body``, joined again."""
    parts = F.struct(all_groups(text, pattern, group).alias("m"), F.split(text, pattern, -1).alias("g"))
    return let(parts, lambda p: F.array_join(F.zip_with(p["g"], p["m"], lambda g, m: body(g, F.coalesce(m, F.lit("")))), ""))


def _line_ends(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\n]+", "")


def python_code_only(content: Column, depth: int = _FORMAT_DEPTH) -> Column:
    """Python text without the bodies of strings and without comments, line by line intact.

    The fields of formatted strings are code: they stay, and strings in them are treated the same way.
    """
    def field(gap: Column, code: Column) -> Column:
        return F.concat(_line_ends(gap), F.lit(" "), python_code_only(code, depth - 1) if depth else code, F.lit(" "))

    def blank(gap: Column, token: Column) -> Column:
        return F.concat(
            gap,
            F.when((token == "") | F.startswith(token, F.lit("#")), "")
            .when(~F.left(token, F.lit(1)).isin("'", '"'), _joined(token, _FIELD, field, 1))
            .when(F.startswith(token, F.lit('"""')) | F.startswith(token, F.lit("'''")), _line_ends(token))
            .otherwise(F.concat(F.left(token, F.lit(1)), F.left(token, F.lit(1)))),
        )

    return _joined(content, _PYTHON_TOKEN, blank, 0)


def _python_imports(code: Column) -> Column:
    code = F.regexp_replace(code, r"\\\n", " ")

    def names(text: Column) -> Column:
        words = F.split(F.regexp_replace(text, r"[()\s]+", " "), ",", -1)
        bare = F.transform(words, lambda w: F.regexp_extract(w, r"(?U)^\s*([\w.]+|\*)", 1))
        return F.filter(bare, lambda w: w != "")

    plain_re = r"(?mU)(?:^|;)[ \t]*import[ \t]+([^\n;]+)"
    from_re = r"(?mU)(?:^|;)[ \t]*from[ \t]+\.*[ \t]*(\w[\w.]*)[ \t]+import[ \t]*(\([^)]*\)|[^\n;]+)"

    def rows(c: Column) -> Column:
        plain = F.array_distinct(F.flatten(F.transform(all_groups(c, plain_re), names)))
        plain = F.transform(
            F.array_sort(plain), lambda n: F.struct(F.lit("import").alias("kind"), n.alias("module"), F.lit(None).cast("string").alias("name"))
        )
        pairs = F.zip_with(
            all_groups(c, from_re, 1),
            all_groups(c, from_re, 2),
            lambda module, text: F.transform(
                names(text), lambda n: F.struct(F.lit("from").alias("kind"), module.alias("module"), n.alias("name"))
            ),
        )
        return F.concat(plain.cast(_IMPORT), F.array_sort(F.flatten(pairs)).cast(_IMPORT))

    return let(code, rows)


def _import_rows(modules: Column) -> Column:
    """Sorted distinct module names in the common import shape."""
    return F.transform(
        F.array_sort(F.array_distinct(modules)),
        lambda m: F.struct(F.lit("import").alias("kind"), m.alias("module"), F.lit(None).cast("string").alias("name")),
    ).cast(_IMPORT)


def import_occurrences(content: Column, language: Column, relative_ruby: bool = False, code: Column | None = None) -> Column:
    """Imports per file as ``array<struct<kind, module, name>>``, sorted and distinct.

    ``code`` is :func:`python_code_only` of the content where that is already known.
    """
    go_spec = r'(?mU)^[ \t]*import[ \t]+(?:[\w.]+[ \t]+)?"([^"\n]+)"'
    go_block = r"(?mU)^[ \t]*import[ \t]*\(([^)]*)\)"
    go = F.concat(
        all_groups(content, go_spec),
        F.flatten(F.transform(all_groups(content, go_block), lambda b: all_groups(b, r'"([^"\n]+)"'))),
    )
    ruby_word = "(?:require_relative|require)" if relative_ruby else "require"
    ruby = all_groups(content, rf"""(?mU)^[ \t]*{ruby_word}[ \t(]+["']([^"'\n]+)["']""")
    many = lambda patterns: F.concat(*[all_groups(content, _EXACT + p) for p in patterns])
    return (
        F.when(language == "python", _python_imports(python_code_only(content) if code is None else code))
        .when(language == "java", _import_rows(all_groups(content, _EXACT + vocab.JAVA_IMPORT)))
        .when(language.isin(*_JAVASCRIPT), _import_rows(many(vocab.JS_IMPORTS)))
        .when(language == "csharp", _import_rows(all_groups(content, _EXACT + vocab.CSHARP_IMPORT)))
        .when(language == "php", _import_rows(many(vocab.PHP_IMPORTS)))
        .when(language == "go", _import_rows(go))
        .when(language == "ruby", _import_rows(ruby))
        .otherwise(_empty(_IMPORT))
    )


def _python_calls(code: Column, words: Sequence[str]) -> Column:
    any_word = "|".join(words)
    dotted = r"(?U)(?<![\w.])(?<!def )(?<!class )([^\W\d]\w*(?:\s*\.\s*\w+)*+)\s*\("
    chained = r"(?U)[)\]]\s*\.\s*(\w+(?:\s*\.\s*\w+)*+)\s*\("

    def of_line(s: Column) -> Column:
        found = F.concat(all_groups(s["t"], dotted), all_groups(s["t"], chained))
        wanted = F.filter(found, lambda n: F.rlike(F.lower(n), F.lit(any_word)))
        return F.transform(
            wanted, lambda n: F.struct(F.regexp_replace(n, r"\s+", "").alias("name"), s["i"].alias("line"))
        )

    gated = _numbered_lines(code, lambda t: F.rlike(t, F.lit(f"(?i)(?:{any_word})")))
    return F.flatten(F.transform(gated, of_line)).cast(_CALL)


def call_occurrences(
    content: Column, language: Column, python_words: Sequence[str] = vocab.PYTHON_CALL_WORDS, code: Column | None = None
) -> Column:
    """Database calls per file as ``array<struct<name, line>>``: one per line and pattern."""
    tables = vocab.DATABASE_CALLS

    def gate(line: Column) -> Column:
        any_call = {
            name: F.rlike(line, F.lit(_EXACT + "|".join(f"(?:{p})" for p, _ in table))) for name, table in tables.items()
        }
        return _by_language(language, any_call, F.lit(False))

    def of_line(s: Column) -> Column:
        names = {
            lang: F.array(*[F.when(F.rlike(s["t"], F.lit(_EXACT + p)), F.lit(name)) for p, name in table])
            for lang, table in tables.items()
        }
        hit = F.array_compact(_by_language(language, names, _empty(_NAMES)))
        return F.transform(hit, lambda n: F.struct(n.alias("name"), s["i"].alias("line")))

    by_pattern = F.flatten(F.transform(_numbered_lines(content, gate), of_line)).cast(_CALL)
    return (
        F.when(language == "python", _python_calls(python_code_only(content) if code is None else code, python_words))
        .when(language.isin(*_JAVASCRIPT, *tables), by_pattern)
        .otherwise(_empty(_CALL))
    )


def class_occurrences(content: Column, language: Column, code: Column | None = None) -> Column:
    """Class definitions per file as ``array<struct<name, bases>>``.

    A qualified base keeps its last part; Java classes carry no bases.
    """
    head = r"(?mU)^[ \t]*class[ \t]+(\w+)[ \t]*(?:\(((?:[^()]|\([^()]*+\))*+)\))?[ \t]*:"

    def bases(text: Column) -> Column:
        parts = F.transform(F.split(F.coalesce(text, F.lit("")), ",", -1), strip)
        return F.transform(
            F.filter(parts, lambda b: F.rlike(b, F.lit(r"(?U)^[\w.]+$"))), lambda b: F.substring_index(b, ".", -1)
        )

    python = let(
        python_code_only(content) if code is None else code,
        lambda c: F.zip_with(
            all_groups(c, head, 1),
            all_groups(c, head, 2),
            lambda n, b: F.struct(n.alias("name"), bases(b).alias("bases")),
        ),
    )
    java = F.transform(
        all_groups(content, r"(?U)\bclass\s+([^\W\d]\w*)"),
        lambda n: F.struct(n.alias("name"), _empty(_NAMES).alias("bases")),
    )
    return (
        F.when(language == "python", python.cast(_CLASS))
        .when(language == "java", java.cast(_CLASS))
        .otherwise(_empty(_CLASS))
    )


def table_definitions(content: Column, language: Column) -> Column:
    """Sorted distinct names in CREATE TABLE statements of SQL files."""
    names = F.array_sort(F.array_distinct(all_groups(content, _CASELESS + vocab.DDL_TABLE)))
    return F.when(language == "sql", names).otherwise(_empty(_NAMES))


def with_language(files: DataFrame) -> DataFrame:
    """Source files with their language; binaries of unknown language are left out."""
    suffix = extension(F.col("path"))
    return files.withColumn("language", detect_language(F.col("path"))).where(~suffix.isin(*vocab.BINARY_EXTENSIONS))


def code_facts(files: DataFrame) -> DataFrame:
    """All facts of every file in one scan: path, language and one array per kind.

    Materialise the result once and derive the flat tables from it.
    """
    content, language, code = F.col("content"), F.col("language"), F.col("code")
    lexed = with_language(files.select("path", "content")).withColumn("code", F.when(language == "python", python_code_only(content)))
    return lexed.select(
        "path",
        "language",
        import_occurrences(content, language, code=code).alias("imports"),
        sql_occurrences(content, language).alias("sql_queries"),
        call_occurrences(content, language, code=code).alias("db_calls"),
        class_occurrences(content, language, code).alias("classes"),
        table_definitions(content, language).alias("tables_defined"),
    )


def scan_code(spark: SparkSession, root: str, **options) -> DataFrame:
    """:func:`code_facts` of every file below ``root``; options go to the file scan."""
    return code_facts(scan_source_files(spark, root, **options))


def _flat(files: DataFrame, column: str, fact: Callable[[Column, Column], Column], *fields: str) -> DataFrame:
    """Explode one kind of fact, from source files or from a code_facts table."""
    if column in files.columns:
        rows = files.select("path", "language", F.explode(column).alias("f"))
    else:
        rows = with_language(files).select(
            "path", "language", F.explode(fact(F.col("content"), F.col("language"))).alias("f")
        )
    return rows.select("path", "language", *fields)


def code_imports(files: DataFrame, relative_ruby: bool = False) -> DataFrame:
    """One row per import: path, language, kind, module, name."""
    fact = partial(import_occurrences, relative_ruby=relative_ruby)
    return _flat(files, "imports", fact, "f.kind", "f.module", "f.name")


def python_imports(files: DataFrame) -> DataFrame:
    """Imports of Python files only."""
    return code_imports(files.where(extension(F.col("path")) == ".py"))


def code_sql(files: DataFrame, whole_words: bool = True, ddl_tables: bool = False) -> DataFrame:
    """One row per embedded SQL string: path, language, query, line, type, table."""
    fact = partial(sql_occurrences, whole_words=whole_words, ddl_tables=ddl_tables)
    return _flat(files, "sql_queries", fact, "f.query", "f.line", "f.type", "f.table")


def python_sql(files: DataFrame) -> DataFrame:
    """Embedded SQL of Python files only."""
    return code_sql(files.where(extension(F.col("path")) == ".py"))


def db_calls(files: DataFrame, python_words: Sequence[str] = vocab.PYTHON_CALL_WORDS) -> DataFrame:
    """One row per database call: path, language, name, line.

    ``python_words`` are the parts a Python call's name must contain one of.
    """
    fact = partial(call_occurrences, python_words=python_words)
    return _flat(files, "db_calls", fact, "f.name", "f.line")


def class_defs(files: DataFrame) -> DataFrame:
    """One row per class: path, language, class_name, bases."""
    return _flat(files, "classes", class_occurrences, F.col("f.name").alias("class_name"), "f.bases")


def tables_defined(files: DataFrame) -> DataFrame:
    """One row per table a SQL file creates: path, language, table."""
    return _flat(files, "tables_defined", table_definitions, F.col("f").alias("table"))


def _line_count(content: Column) -> Column:
    """Lines as a text reader counts them: a trailing part line is a line."""
    breaks = F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit("")))
    partial = (F.length(content) > 0) & ~F.endswith(content, F.lit("\n"))
    return breaks + F.when(partial, 1).otherwise(0)


def lines_of_code(files: DataFrame, extensions: Sequence[str] | None = None) -> DataFrame:
    """Total lines of files in a known language, optionally of some suffixes only."""
    known = files.where(detect_language(F.col("path"), vocab.INVENTORY_LANGUAGES, None).isNotNull())
    if extensions:
        known = known.where(extension(F.col("path")).isin(*extensions))
    return known.agg(F.coalesce(F.sum(_line_count(F.col("content"))), F.lit(0)).cast("bigint").alias("lines_of_code"))


def language_counts(files: DataFrame) -> DataFrame:
    """Files and lines per language; files of unknown suffix have a NULL language."""
    return (
        files.select(
            detect_language(F.col("path"), vocab.INVENTORY_LANGUAGES, None).alias("language"),
            _line_count(F.col("content")).alias("lines"),
            file_name(F.col("path")).isin(*vocab.DEPENDENCY_MANIFESTS).cast("bigint").alias("manifest"),
        )
        .groupBy("language")
        .agg(
            F.count("*").alias("files"),
            F.coalesce(F.sum("lines"), F.lit(0)).cast("bigint").alias("lines"),
            F.coalesce(F.sum("manifest"), F.lit(0)).cast("bigint").alias("manifests"),
        )
    )


def repo_inventory(files: DataFrame) -> DataFrame:
    """One row: total_files, lines_of_code, language_count, languages, dependency_file_count.

    Files shrink to one row per language first; the manifest paths themselves
    are the :func:`dependency_files` relation.
    """
    known = F.col("language").isNotNull()
    entries = F.collect_list(F.when(known, F.struct("language", "files")))
    return language_counts(files).agg(
        F.coalesce(F.sum("files"), F.lit(0)).cast("bigint").alias("total_files"),
        F.coalesce(F.sum(F.when(known, F.col("lines"))), F.lit(0)).cast("bigint").alias("lines_of_code"),
        F.count_if(known).cast("bigint").alias("language_count"),
        F.map_from_entries(F.array_sort(entries)).alias("languages"),
        F.coalesce(F.sum("manifests"), F.lit(0)).cast("bigint").alias("dependency_file_count"),
    )


def dependency_files(files: DataFrame) -> DataFrame:
    """Paths of dependency manifests."""
    return files.where(file_name(F.col("path")).isin(*vocab.DEPENDENCY_MANIFESTS)).select("path")
