"""Source files that do not parse (problem 2).

Every file's text is judged once, in one map over the scan: no shuffle moves a text. Its chunks become maps of lexer states
with bracket summaries, which are reduced associatively (``lexer_states``): what doesn't end, or isn't balanced, is invalid.
What is balanced goes to grammars: Rust's are local, each bracketed group being parsed once for each shape it has and its
verdict remembered (``srclens.rust.grammar``); JavaScript, where the lexer needs all brackets before a slash, has a parser of
its own, JSON, TOML and Python those of the standard library.

Cases: a null text is no file to judge and gives no row; an empty text is a valid rs, py, js or toml file and an invalid
json file; repeated rows of a file count once; an extension is the part of the path after its last dot, in lower case;
other extensions, null paths and null ids give no row; further columns of the input are ignored.
"""

from __future__ import annotations

import ast
import json
import re
import tomllib
import warnings
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.functions.deep import deep
from srclens.llm import ecmascript, lexer_states
from srclens.rust import grammar, lexer
from srclens.rust.measure import failure_line

EXTENSIONS = ("rs", "py", "js", "json", "toml")
warnings.filterwarnings("ignore", category=SyntaxWarning)
warnings.filterwarnings("ignore", category=DeprecationWarning)


def extension(path: str | Column = "relative_path") -> Column:
    """Lower-case extension of a path: what follows the last dot of its last part; empty where there is none."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]*)$", 1))


def _constant(word: str) -> None:
    raise ValueError(f"{word} is no JSON value")


_JSON = json.JSONDecoder(parse_constant=_constant, parse_int=str, parse_float=str)


def _line(text: str, at: int) -> int:
    return text.count("\n", 0, max(0, at)) + 1


def check_json(text: str) -> tuple[int, str] | None:
    try:
        _JSON.decode(text)
    except json.JSONDecodeError as e:
        return e.lineno, e.msg
    except ValueError as e:
        return 1, str(e)
    except RecursionError:
        return _deep_json(text)
    return None


_JSON_TOKEN = re.compile(
    r'[ \t\r\n]*(?:(?P<v>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"|-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?(?![0-9.])|true|false|null)|(?P<p>[\[\]{}:,])|(?P<e>\Z))'
)


def _deep_json(text: str) -> tuple[int, str] | None:
    """JSON nested deeper than the decoder goes: one pass with a stack of what is open."""
    stack: list[str] = []
    want, at = "value", 0  # value, first (value or end), key, first key, colon, after
    while True:
        m = _JSON_TOKEN.match(text, at)
        if m is None:
            return _line(text, at), "unexpected character"
        kind, token = m.lastgroup, m.group(m.lastgroup)
        if kind == "e":
            return None if want == "after" and not stack else (_line(text, at), "unexpected end")
        at = m.end()
        if want in ("value", "first") and (kind == "v" or token in "[{"):
            if kind == "v":
                want = "after"
            else:
                stack.append(token)
                want = "first" if token == "[" else "first key"
        elif want in ("key", "first key") and kind == "v" and token[0] == '"':
            want = "colon"
        elif want == "colon" and token == ":":
            want = "value"
        elif want == "after" and token == "," and stack:
            want = "value" if stack[-1] == "[" else "key"
        elif token == "]" and stack and stack[-1] == "[" and want in ("after", "first") or token == "}" and stack and stack[-1] == "{" and want in ("after", "first key"):
            stack.pop()
            want = "after"
        else:
            return _line(text, m.start()), "unexpected token"


def check_toml(text: str) -> tuple[int, str] | None:
    try:
        deep(tomllib.loads, text)
    except tomllib.TOMLDecodeError as e:
        m = re.search(r"at line (\d+)", str(e))
        return int(m.group(1)) if m else 1, str(e)
    except ValueError as e:
        return 1, str(e)
    return None


def parse_python(text: str) -> ast.Module | tuple[int, str]:
    try:
        return ast.parse(text)
    except SyntaxError as e:
        return e.lineno or 1, e.msg or "invalid syntax"
    except RecursionError:
        return ast.Module([], [])  # the text was accepted, only its tree is too deep to be handed out
    except (ValueError, MemoryError) as e:
        return 1, str(e)  # null bytes, and what is nested beyond the language's own parser


def check_rust(toks: list[str], text: str | None = None) -> tuple[int, str] | None:
    """What makes a list of tokens invalid; the line is 0 without the ``text`` they are from."""
    classes = lexer.classes(toks)
    if "X" in classes:
        at = next(n for n, t in enumerate(toks) if lexer.classes([t]) == "X")
        return _token_line(text, at), "token that no rule allows: " + toks[at][:40]
    flat, bad = deep(grammar.balance, classes)
    if bad >= 0:
        seen = (n for n, t in enumerate(toks) if lexer.classes([t]))
        return _token_line(text, next((n for k, n in enumerate(seen) if k == bad), len(toks))), "bracket without partner"
    if deep(grammar.items, flat, "items"):
        return None
    return deep(failure_line, text, toks) if text else 0, "item or statement that the grammar doesn't allow"


def _token_line(text: str | None, at: int) -> int:
    """Line of a token by its number; the last line for one past the end."""
    if not text:
        return 0
    for n, m in enumerate(lexer._TOKEN.finditer(text)):
        if n == at:
            return _line(text, m.start(1))
    return _line(text.rstrip(), len(text))


def check(ext: str, text: str) -> tuple[int, str] | None:
    """Line (0: not known) and message of what makes a text invalid; None if it parses."""
    if ext in lexer_states.LANGUAGES and (at := lexer_states.open_or_unbalanced(ext, text)) >= 0:
        return _line(text.rstrip(), at), "string, comment or bracket without its other end"
    if ext == "rs":
        return check_rust(lexer.tokens(text), text)
    if ext == "py":
        got = parse_python(text)
        return got if isinstance(got, tuple) else None
    if ext == "js":
        try:
            ecmascript.parse(text)
        except ecmascript.Bad as e:
            return _line(text, e.at), "unexpected token"
        return None
    return check_json(text) if ext == "json" else check_toml(text)


def failures(source_files: DataFrame) -> DataFrame:
    """``file_id``, ``line`` (0 where it isn't known) and ``message`` of each file that doesn't parse, one row a file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(f, *bad) for f, e, t in zip(pdf.file_id, pdf.ext, pdf.text) if (bad := check(e, t)) is not None]
            yield pd.DataFrame(out, columns=["file_id", "line", "message"])

    judged = source_files.select("file_id", extension().alias("ext"), "text").where(
        F.col("ext").isin(*EXTENSIONS) & F.col("text").isNotNull() & F.col("file_id").isNotNull()
    )
    return judged.mapInPandas(run, "file_id bigint, line bigint, message string").dropDuplicates(["file_id"])


def rates(source_files: DataFrame, parse_failures: DataFrame, bad: DataFrame) -> DataFrame:
    """Files, files that don't parse, their share, and how many of the latter the log names, by repository and extension.

    The log's paths may be written as ``./a\\b`` or absolute; they are matched by a file's path in the repository and by its absolute path.
    """
    plain = lambda c: F.regexp_replace(F.lower(F.translate(F.trim(c), "\\", "/")), r"^(\./|/)+", "")
    absolute = plain(F.col("absolute_path")) if "absolute_path" in source_files.columns else F.lit(None).cast("string")
    files = source_files.select(
        "file_id", "repo", plain(F.col("relative_path")).alias("path"), absolute.alias("absolute"), extension().alias("language"), F.col("text").isNotNull().alias("has_text")
    ).where(F.col("language").isin(*EXTENSIONS) & F.col("has_text")).dropDuplicates(["file_id"]).drop("has_text")
    log = parse_failures.select("repo", plain(F.col("path")).alias("name")).where("name is not null").distinct()
    names = files.select("file_id", "repo", F.explode(F.array_distinct(F.array_compact(F.array("path", "absolute")))).alias("name"))
    logged = names.join(log, ["repo", "name"], "left_semi").select("file_id", F.lit(1).alias("logged")).distinct()
    return (
        files.join(bad.select("file_id", F.lit(1).alias("bad")), "file_id", "left")
        .join(logged, "file_id", "left")
        .groupBy("repo", "language")
        .agg(
            F.count("*").alias("files"),
            F.count("bad").alias("failing"),
            F.count(F.when(F.col("bad").isNotNull(), F.col("logged"))).alias("failing_in_log"),
            F.count(F.when(F.col("bad").isNull(), F.col("logged"))).alias("parsing_in_log"),
        )
        .withColumn("rate", F.col("failing") / F.col("files"))
    )
