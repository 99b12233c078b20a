"""Generated, minified or vendored source files and data saved as code (problem 1).

A Merkle tree, hashed bottom-up: blocks of a file's code lines (cut behind lines whose own hash says so, so that an edit
changes one or two blocks), files, and directories, whose hashes bind their children's names. What unrelated trees share
was copied in:

* a directory with two or more files of code, or a long file, that two repositories, or a repository and a library, have;
* a file a fourth of whose lines lie in blocks of one library's file, so that a copy is found wherever it lies and also if
  it was changed a little. Blocks that several libraries have tell nothing and don't count.

Header and layout rules on each file's own text find the rest (a tool's notice in the head comment, numbered families of
declarations, dense long lines, bodies made of numbers or opaque strings). Texts are read in one map and never shuffled.

Cases: null text, null path, null id and other extensions give no row; an empty file is hand-written; repeated rows count
once; a file without a row in clone_inputs, or with ``editable`` null, counts as editable; files without code have no part
in directories' hashes; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from srclens.llm.source_syntax import extension
from srclens.operators.checkpoints import durable, small

LANGUAGES = ("rs", "py", "js")
LONG_LINE = 16  # characters besides white space that make a line telling
BLOCK_LINES = 2  # telling lines in a block, on average
SHARED_LINES = 0.25  # of the smaller file's telling lines, and
LEAST_LINES = 5  # how many of them, that make a copy if they lie in shared blocks
SUBTREE_LINES = 30  # telling lines of a single file, or two files of a directory, that a chance match can't explain
# What tools write at the head of what they make, in several languages.
GENERATED = re.compile(
    r"@generated\b|\b(?:auto|automatically|machine)[- ]?generated\b|\bgenerated (?:by|from|automatically|code|file|with)\b"
    r"|\bdo(?: not|n't) (?:edit|modify|change)\b(?! (?:without|unless|until|before|if)\b)|\b(?:changes?|edits?)\b.*\b(?:will|may) be (?:lost|overwritten|discarded)"
    r"|\b(?:produced|built|emitted|created|written|compiled) (?:by|from)\b.*(?:\bbuild\b|\blost\b|\boverwritten\b|\bautomatically\b)"
    r"|\b(?:produit|généré|genere)e? (?:par|automatiquement)\b|\bne pas (?:modifier|éditer)\b"
    r"|\b(?:automatisch|maschinell) (?:erzeugt|generiert|erstellt)\b|\bnicht (?:von hand|manuell) (?:ändern|bearbeiten|editieren)\b"
    r"|\b(?:generado|producido) (?:por|automáticamente)\b|\bno (?:editar|modificar)\b",
    re.I,
)
# Words by which a head comment says the contrary.
BY_HAND = re.compile(r"\bnot (?:auto-?)?generated\b|\b(?:typed|written|maintained|kept) by hand\b|\bhand-?(?:written|maintained)\b", re.I)
# Folders that hold other people's code.
VENDOR = r"(?i)(?:^|/)(?:vendor|vendored|third[_-]?party|3rdparty|thirdparty|external|externals|extern|deps|node_modules|bower_components|site-packages)/"
_BANNER = re.compile(r"^[\s/#*!]*[A-Za-z][\w.-]* v?\d+(?:\.\d+)+\b", re.M)
_NUMBERED = re.compile(r"\b([A-Za-z_]\w*?)_?(?<!\d)(\d{1,18})\b")  # a longer number doesn't run
_NUMBER = re.compile(r"(?<![\w.])-?(?:0[xX][0-9a-fA-F_]+|\d[\d_]*(?:\.\d+)?(?:[eE][+-]?\d+)?)(?:[iu]\d+|f\d+)?(?![\w.])")
_STRING = re.compile(r'"([^"\\\n]{60,}|(?:[^"\\\n]|\\.){60,})"|\'([^\'\\\n]{60,})\'|`([^`\\]{60,})`')
_COMMENT = re.compile(r"\s*(?://|/\*|\*|#(?!\[|!\[))")
_SPACE = str.maketrans("", "", " \t\r\n\x0b\x0c")


def _each_line(text: str) -> Iterator[str]:
    start = 0
    while (end := text.find("\n", start)) >= 0:
        yield text[start:end]
        start = end + 1
    yield text[start:]


def head_comment(text: str) -> str:
    """The comments, and a leading docstring, before the first line of code; inner attributes are no code."""
    out: list[str] = []
    open_mark = ""
    for line in _each_line(text):
        s = line.strip().removeprefix("\ufeff")
        if open_mark:
            out.append(s)
            if open_mark in s:
                open_mark = ""
        elif not s or s.startswith("#!"):
            continue
        elif s.startswith(("'''", '"""')):
            out.append(s)
            if s[:3] not in s[3:]:
                open_mark = s[:3]
        elif s.startswith("/*"):
            out.append(s)
            if "*/" not in s:
                open_mark = "*/"
            elif s[s.index("*/") + 2 :].strip():
                break
        elif s.startswith("//") or (s[0] == "#" and not s.startswith("#[")):
            out.append(s)
        else:
            break
    return "\n".join(out)


def says_generated(head: str) -> bool:
    return any(GENERATED.search(line) and not BY_HAND.search(line) for line in head.split("\n"))


def numbered(lines: list[str]) -> bool:
    """Whether declarations that differ by a running number make up the file."""
    families: dict[str, set[int]] = {}
    holding: dict[str, int] = {}
    for line in lines:
        for stem in {(m[0], m[1]) for m in _NUMBERED.findall(line)}:
            families.setdefault(stem[0], set()).add(int(stem[1]))
            holding[stem[0]] = holding.get(stem[0], 0) + 1
    running = [stem for stem, numbers in families.items() if len(numbers) >= 8 and max(numbers) - min(numbers) < 1.5 * len(numbers) + 2]
    return bool(running) and sum(holding[stem] for stem in running) >= 0.18 * len(lines)


def origin(text: str) -> str:
    """generated, minified or data for what the text itself shows; empty for none."""
    head = head_comment(text)
    if head and says_generated(head):
        return "generated"
    lines = [x for x in text.split("\n") if x and not x.isspace() and not _COMMENT.match(x)]
    if not lines:
        return ""
    body = "\n".join(lines)
    solid = len(body.translate(_SPACE))
    digits = sum(map(body.count, "0123456789"))
    if digits > 0.12 * solid:
        numbers = _NUMBER.findall(body)
        if len(numbers) >= 100 and sum(map(len, numbers)) > 0.6 * len(body.translate(_SPACE).replace(",", "")):
            return "data"
    if len(body) > 60 * len(lines):
        opaque = sum(len(s) for m in _STRING.findall(body) for s in m if s and " " not in s)
        if opaque > 0.5 * solid and opaque >= 300:
            return "data"
        if len(body) >= 200 and len(body) - solid < 0.12 * len(body) and len(body) > 110 * len(lines):
            return "minified"
    if digits > 0.01 * solid and numbered(lines):
        return "generated"
    return ""


def blocks(text: str) -> tuple[int, list[tuple[int, int]]]:
    """The hash of a file's code, and its blocks as (hash, lines); white space and comments are left out, so that layout and licence don't matter."""
    out: dict[int, int] = {}
    whole, block = xxhash.xxh64(), xxhash.xxh64()
    held = 0
    for line in _each_line(text):
        code = line.translate(_SPACE)
        if len(code) < LONG_LINE or code.startswith(("//", "#", "/*", "*")):
            continue
        raw = code.encode("utf-8", "replace")
        block.update(raw + b"\n")
        held += 1
        if xxhash.xxh64_intdigest(raw) % BLOCK_LINES == 0:
            digest = block.intdigest() - (1 << 63)
            whole.update(block.digest())
            out[digest] = held
            block, held = xxhash.xxh64(), 0
    if held:
        whole.update(block.digest())
        out[block.intdigest() - (1 << 63)] = held
    return whole.intdigest() - (1 << 63), list(out.items())


def _measured(source_files: DataFrame) -> DataFrame:
    """Per file: ``origin`` by its own text, ``banner``, the hash of its code, its blocks and how many lines they have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            trees = [blocks(t) for t in texts]
            flat = [b for _, found in trees for b in found]
            bounds = [0, *accumulate(len(found) for _, found in trees)]
            pairs = pa.StructArray.from_arrays([pa.array([h for h, _ in flat], pa.int64()), pa.array([n for _, n in flat], pa.int32())], ["hash", "lines"])
            yield pa.RecordBatch.from_arrays([
                *(batch.column(c) for c in ("file_id", "repo", "path")), pa.array([origin(t) for t in texts], pa.string()),
                pa.array([bool(_BANNER.search(head_comment(t))) for t in texts], pa.bool_()), pa.array([sum(n for _, n in found) for _, found in trees], pa.int32()),
                pa.array([d for d, _ in trees], pa.int64()), pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pairs),
            ], names=["file_id", "repo", "path", "origin", "banner", "code_lines", "digest", "blocks"])

    return source_files.mapInArrow(
        run, "file_id bigint, repo string, path string, origin string, banner boolean, code_lines int, digest bigint, blocks array<struct<hash: bigint, lines: int>>"
    )


def _code(files: DataFrame, key: str, owner: str) -> DataFrame:
    return files.select(
        F.col(key).alias("file_id"), F.coalesce(F.col(owner), F.lit("")).alias("repo"), F.col("relative_path").alias("path"), "text"
    ).where(extension().isin(*LANGUAGES) & F.col("text").isNotNull() & F.col(key).isNotNull())


def copies_of_catalogue(measured: DataFrame, upstream: DataFrame) -> DataFrame:
    """``file_id`` of files that share enough of their lines, in whole blocks, with one file of the catalogue (or the other way round)."""
    held = upstream.select(F.col("file_id").alias("upstream_id"), F.col("repo").alias("library"), F.col("code_lines").alias("up_lines"), F.explode("blocks").alias("b"))
    held = held.select("upstream_id", "library", "up_lines", F.col("b.hash").alias("hash"))
    # Only blocks of a single library tell, which also bounds how many rows a block that many files have can meet.
    telling = held.groupBy("hash").agg(F.min("library").alias("a"), F.max("library").alias("b")).where("a = b").select("hash")
    catalogue = small(durable(held.join(telling, "hash", "left_semi").select("hash", "upstream_id", "up_lines")))
    own = measured.select("file_id", "code_lines", F.explode("blocks").alias("b")).select("file_id", "code_lines", F.col("b.hash").alias("hash"), F.col("b.lines").alias("lines"))
    shared = own.join(catalogue, "hash").distinct().groupBy("file_id", "upstream_id", "code_lines", "up_lines").agg(F.sum("lines").alias("shared"))
    return shared.where((F.col("shared") >= LEAST_LINES) & (F.col("shared") >= SHARED_LINES * F.least("code_lines", "up_lines"))).select("file_id").distinct()


def merkle(leaves: DataFrame) -> DataFrame:
    """``tree``, ``path`` (of a directory), ``digest``, ``files`` for every directory, from leaves (tree, path, digest).

    Level by level from the deepest: a directory's hash is that of the sums of its children's hashes, each bound to the
    child's name, which needs no order and is combined before the shuffle.
    """
    leaves = leaves.select("tree", "path", "digest", F.lit(1).cast("bigint").alias("files"), F.size(F.split("path", "/")).alias("depth"))
    deepest = leaves.agg(F.max("depth")).first()[0] or 1
    level: DataFrame | None = None
    levels = []
    for depth in range(deepest, 1, -1):
        at = leaves.where(F.col("depth") == depth)
        at = at if level is None else at.unionByName(level)
        parent = F.regexp_replace("path", r"/[^/]*$", "")
        bound = at.withColumn("h", F.xxhash64(F.regexp_extract("path", r"([^/]*)$", 1), "digest"))
        level = durable(
            bound.groupBy("tree", parent.alias("path"))
            .agg(
                F.sum(F.col("h").bitwiseAND(F.lit(0x7FFFFFFF))).alias("low"),
                F.sum(F.shiftrightunsigned("h", 32)).alias("high"),
                F.sum("files").alias("files"),
                F.count("*").alias("children"),
            )
            .select("tree", "path", F.xxhash64("low", "high", "children").alias("digest"), "files", F.lit(depth - 1).alias("depth"))
        )
        levels.append(level)
    if not levels:
        return leaves.limit(0)
    return reduce(DataFrame.unionByName, levels)


def shared_subtrees(measured: DataFrame, upstream: DataFrame) -> DataFrame:
    """``file_id`` and ``whole`` (a directory, not the file alone) of files in what unrelated owners have with the same hash.

    A repository is one owner and one tree, a library one owner with a tree for each version.
    """
    cols = ["owner", "tree", "path", "digest", "code_lines"]
    own = measured.where("code_lines > 0").withColumn("owner", F.col("repo")).withColumn("tree", F.col("repo")).select("file_id", *cols).dropDuplicates(["file_id"])
    other = upstream.where("code_lines > 0").withColumn("owner", F.concat(F.lit("library:"), "repo")).withColumn("tree", F.concat(F.lit("library:"), "repo", F.lit(" "), "version"))
    both = own.select(*cols).unionByName(other.select(*cols))
    owners = F.when(F.col("tree").startswith("library:"), F.substring_index("tree", " ", 1)).otherwise(F.col("tree")).alias("owner")
    trees = merkle(both).where(F.col("files") >= 2).select(owners, "tree", "path", "digest", F.lit(True).alias("whole"))
    nodes = trees.unionByName(both.where(F.col("code_lines") >= SUBTREE_LINES).select("owner", "tree", "path", "digest", F.lit(False).alias("whole")))
    shared = nodes.groupBy("digest").agg(F.min("owner").alias("a"), F.max("owner").alias("b")).where("a <> b").select("digest")
    places = durable(nodes.join(shared, "digest", "left_semi").groupBy("tree", F.col("path").alias("node")).agg(F.bool_or("whole").alias("whole")))
    parts = F.split("path", "/")
    ancestors = own.select("file_id", "tree", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("node"))
    return ancestors.join(places, ["tree", "node"]).groupBy("file_id").agg(F.bool_or("whole").alias("whole"))


def evidence(source_files: DataFrame, clone_inputs: DataFrame, upstream: DataFrame) -> DataFrame:
    """``file_id``, ``origin`` and ``evidence`` (text, blocks, directory, file or place), one row for each kind a file has."""
    measured = durable(_measured(_code(source_files, "file_id", "repo")))
    versions = upstream.select(F.col("upstream_id").alias("file_id"), F.coalesce(F.col("version") if "version" in upstream.columns else F.lit(""), F.lit("")).alias("version"))
    catalogue = durable(_measured(_code(upstream, "upstream_id", "library")).join(versions.dropDuplicates(["file_id"]), "file_id"))
    by_text = measured.where("origin <> ''").select("file_id", "origin", F.lit("text").alias("evidence"))
    read_only = clone_inputs.where("file_id is not null").groupBy("file_id").agg(F.min(F.coalesce("editable", F.lit(True))).alias("editable")).where("not editable")
    foreign = measured.where(F.col("path").rlike(VENDOR) & (F.col("origin") == ""))
    by_place = foreign.where("banner").select("file_id").unionByName(foreign.where("not banner").join(read_only, "file_id", "left_semi").select("file_id"))
    vendored = lambda df, kind: df.select("file_id", F.lit("vendored").alias("origin"), (kind if isinstance(kind, Column) else F.lit(kind)).alias("evidence"))
    subtrees = vendored(shared_subtrees(measured, catalogue), F.when(F.col("whole"), "directory").otherwise("file"))
    return by_text.unionByName(vendored(copies_of_catalogue(measured, catalogue), "blocks")).unionByName(subtrees).unionByName(vendored(by_place, "place")).distinct()


def not_hand_written(source_files: DataFrame, clone_inputs: DataFrame, upstream: DataFrame) -> DataFrame:
    """``file_id`` and ``origin`` (generated, minified, data or vendored) of every file that nobody wrote by hand in its repository."""
    return evidence(source_files, clone_inputs, upstream).groupBy("file_id").agg(F.min("origin").alias("origin"))
