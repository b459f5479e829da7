"""Files that nobody wrote by hand here: generated, minified, vendored, or data kept as code.

Vendored code is found by Merkle hashes, computed bottom-up over the directory trees: a file or directory with the same
hash in the trees of unrelated workspaces is a copy. Hashes are of contents without their leading comment, white space and
line ends, so a copy under a new licence header is the same. Workspaces that have most of their files in common, at the
same places, are checkouts or forks of one origin and prove nothing about each other.

Header and layout rules tell the rest. A header states that a tool produced the file or that it is a copy from outside;
a licence or a copyright by itself states neither. The layout gives away minified lines, resolved dependencies, accessors
as generators write them, and tables of data. The name of a directory is no evidence by itself: it counts where the corpus
bears it out, i.e. where a good share of all the files in directories of that name have evidence of their own.

A directory's hash combines those of its entries by sums, which Spark aggregates before the shuffle; a directory with any
number of entries is no large group.

Defined results: a file delivered repeatedly counts once; null contents and null paths have no case; an empty file is
hand-written. Files that differ under one path are judged each, and the path is found if one of them is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trovelode.llm.neardup import connected
from trovelode.tables import checkpointed, spread

#: Characters, as compared, that a shared file or directory has at least to be evidence; all files count in the hashes.
EVIDENCE_FROM = 200

#: Two workspaces are of one origin if so large a share of the files of the smaller one is at the same places in the other.
ONE_ORIGIN_FROM = 0.8
#: A directory's name counts if so large a share of the files in such directories has evidence of its own, with
#: ``NAME_PRIOR`` more files without any added, so that one or two files prove nothing.
NAME_FROM, NAME_PRIOR = 0.2, 5

#: Directories that tools write to, names that tools give to their files, and directories for outside code.
GENERATED_DIRECTORIES = {"generated", "__generated__", "gen", "autogen", "codegen-out", "generated-sources", "auto-generated"}
GENERATED_NAMES = re.compile(
    r"(_pb2(_grpc)?\.pyi?|\.pb\.(go|cc|h|ts|js)|\.pb-c\.[ch]|\.(generated|g|gen|designer|auto)\.\w+|_generated\.\w+|OuterClass\.java)$",
    re.I,
)
VENDORED_DIRECTORIES = {
    "vendor", "vendored", "third_party", "third-party", "thirdparty", "3rdparty", "external", "deps", "node_modules",
    "bower_components", "site-packages", "ext",
}

#: What a line of a header says. ``TOOL`` stands for a name and what follows it up to the end of the statement.
_GENERATED_HEADER = re.compile(
    r"""<auto-?generated\b
      | @generated\b
      | ^\W*auto-?generated\W+(by|from|file|code|produced)\b
      | ^\W*(this\s+(file|module|code)\s+(is|was|has\s+been)\s+)?(automatically\s+|auto-?)?(generated|produced|created)\s+(from|by)\s+(?!hand)\S+
      | \bcode\s+generated\b.*\bdo\s+not\s+edit\b
      | \bgenerated\b.*\bdo\s+not\s+(edit|modify)\b
      | ^\W*(eslint-disable\W+)?built\s+by\s+the\s+.+\bstep\b.*\binstead\b
      | \bmanual\s+changes\s+will\s+be\s+(lost|overwritten)\b
      | \bdiese[rs]?\s+(datei|modul|code)\s+(wird|wurde)\b.*\b(erzeugt|generiert)\b
      | \bce\s+(fichier|module|code)\s+(est|a\s+été)\b.*\b(généré|produit)\b
      | \beste\s+(archivo|fichero|módulo|código)\s+(es|fue|ha\s+sido)\b.*\bgenerado\b
    """,
    re.I | re.X,
)
_VENDORED_HEADER = re.compile(
    r"""^\W*vendored\s+(from|copy)\b
      | ^\W*(imported|verbatim|unmodified)\s+copy\s+of\b
      | ^\W*upstream:\s+\S
      | ^\W*local\s+modifications:
      | \bv\d+\.\d+[\w.]*\s+\|\s+\(c\)\s
    """,
    re.I | re.X,
)
#: Lines that together are the banner of a package: its version and its licence.
_VERSION = re.compile(r"^\W*version:\s+v?\d+\.\d", re.I)
_LICENCE = re.compile(r"^\W*licen[cs]e:\s+[A-Z]", re.I)
#: A project that owns the text, and the distribution that has its licence.
_OWNER = re.compile(r"copyright\s+\(c\)\s+the\s+(\S+)\s+project\s+authors", re.I)
_DISTRIBUTION = re.compile(r"\blicen[cs]e\b.*\bin\s+the\s+(\S+)\s+(distribution|repository|source\s+tree)\b", re.I)
#: Lines as generators write them.
_GENERATED_BODY = re.compile(
    r"""^_[A-Z0-9_]+\s*=\s*_descriptor\.|_descriptor\.FieldDescriptor\(|serialized_start=\d
      | \bextends\s+AbstractStub\b|_FIELD_NUMBER\s*=\s*\d|\bbitField0_\b
      | ^func\s+\(x\s+\*\w+\)\s+Get\w+\(\)|^\s*if\s+x\s+!=\s+nil\s*\{|^\s*return\s+x\.\w+$
      | \bkind:\s*'(Document|OperationDefinition|FieldNode|Name|SelectionSet)'
    """,
    re.X,
)
_RESOLVED = re.compile(r"""^\s*["']?(resolved|integrity|checksum)["']?\s*[:=]|"resolved"\s*:|"integrity"\s*:""")
_DATA = re.compile(
    r"""^\s*[\[({]?\s*(["']?[-+]?(0x[0-9a-f]+|\d[\d_.]*(e[-+]?\d+)?)["']?\s*,\s*){3,}.*$
      | ^\s*INSERT\s+INTO\s+\S+(\s*\([^)]*\))?\s+VALUES\s*\(
      | ^\s*\{\s*("[\w$]{1,24}"\s*:\s*("[^"]*"|[-+\d.eE]+|true|false|null)\s*,?\s*){3,}\}\s*,?\s*$
      | ^[\s"'+]*([rbu]{1,2}["'])?[A-Za-z0-9+/]{56,}={0,2}["'\s,;+\\]*$
    """,
    re.I | re.X,
)
_ENCODED = re.compile(r"(?:data:[\w/+.-]+;base64,)?[A-Za-z0-9+/]{200,}={0,2}|\b(?:[0-9a-f]{2}[\s,:]*){100,}\b")
_COMMENT = re.compile(r"""^\s*(//|\#(?!\[|include|define|if|endif|pragma)|/\*|\*|--|<!--|;|"_?comment"\s*:|"//"\s*:|"{3}|'{3}|%)""")
_MEMBER = re.compile(r"""^"(?:_?comment|//)"\s*:\s*""")
_KEY_BLOCK = re.compile(r"-----BEGIN [A-Z ]+-----.*?-----END [A-Z ]+-----", re.S)
_CODE_NAMES = re.compile(r"[A-Za-z_$][\w$]*")


def header(text: str) -> list[str]:
    """The lines of the comments that a file begins with (and of a comment member that JSON begins with)."""
    lines, block = [], False
    for line in text.lstrip("﻿").splitlines():
        bare = line.strip()
        if block or _COMMENT.match(bare):
            lines.append(_MEMBER.sub("", bare))
            if bare.startswith("/*") or bare.startswith("<!--"):
                block = True
            if "*/" in bare or "-->" in bare:
                block = False
        elif bare and not bare.startswith(("#!", "<?", "{", "package ", "'use strict'", '"use strict"')):
            break
    return lines


def is_minified(text: str) -> bool:
    """Long lines with little white space; prose in a string has spaces and is none."""
    lines = [line for line in text.splitlines() if line.strip()]
    long = [line for line in lines if len(line) >= 300]
    dense = sum(len(line) for line in long if sum(map(line.count, " \t")) < 0.06 * len(line) and len(_CODE_NAMES.findall(line)) > 0.04 * len(line))
    return dense >= 0.6 * max(1, sum(map(len, lines)))


def reasons(path: str, text: str) -> list[str]:
    """Why a file counts as not written by hand; empty if it doesn't."""
    found = []
    head = header(text)
    if any(_GENERATED_HEADER.search(line) for line in head):
        found.append("generated header")
    if any(_VENDORED_HEADER.search(line) for line in head) or is_foreign(path, head):
        found.append("vendored header")
    if GENERATED_NAMES.search(path):
        found.append("generated name")
    lines = [line for line in text.splitlines() if line.strip()]
    if lines:
        size = sum(map(len, lines))
        if sum(1 for line in lines if _GENERATED_BODY.search(line)) >= max(4, 0.25 * len(lines)):
            found.append("generated layout")
        if sum(1 for line in lines if _RESOLVED.search(line)) >= max(3, 0.2 * len(lines)):
            found.append("resolved dependencies")
        if is_minified(text):
            found.append("minified")
        rest = _KEY_BLOCK.sub("", text)  # a key in a configuration is no table
        data = sum(len(line) for line in rest.splitlines() if _DATA.match(line))
        encoded = sum(map(len, _ENCODED.findall(rest)))
        remarks = sum(1 for line in lines if _COMMENT.match(line) or re.search(r"\s(//|#|--)\s|/\*", line))
        if max(data, encoded) >= 0.6 * size and (encoded >= 1000 or len(lines) >= 12) and remarks <= 0.2 * len(lines):
            found.append("data")
    return found


def is_foreign(path: str, head: list[str]) -> bool:
    """Whether a header names another project as the owner, twice, or is the banner of a package with its version."""
    if any(map(_VERSION.search, head)) and any(map(_LICENCE.search, head)):
        return True
    owners = {m.group(1).lower() for m in map(_OWNER.search, head) if m} - {path.split("/", 1)[0].lower()}
    return bool(owners) and any(m.group(1).lower() in owners for m in map(_DISTRIBUTION.search, head) if m)


def conventional(path: str) -> list[str]:
    """Names of directories for generated or outside code that a path goes through. The latter hold a directory for each
    package, so a file right in one of them is none."""
    parts = path.lower().split("/")[1:-1]
    return [f"generated place {d}" for d in parts if d in GENERATED_DIRECTORIES] + [f"vendored place {d}" for d in parts[:-1] if d in VENDORED_DIRECTORIES]


def bare(text: str) -> str:
    """The content without leading comments, white space and line ends."""
    lines = text.lstrip("﻿").splitlines()
    start, block = 0, False
    for line in lines:
        now = line.strip()
        if block or not now or _COMMENT.match(now):
            block = (block or now.startswith(("/*", "<!--"))) and "*/" not in now and "-->" not in now
            start += 1
        else:
            break
    return "".join("".join(lines[start:]).split())


def judged(files: DataFrame) -> DataFrame:
    """(path, workspace, reasons array, names array, content_hash long, n_chars int) of each file: why it counts, the
    conventional names in its path, and hash and size of :func:`bare`."""
    source = spread(files.select("path", "workspace", "content").where("path is not null and content is not null"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            why, names, hashes, sizes = [], [], [], []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                why.append(reasons(path, text))
                names.append(sorted(set(conventional(path))))
                rest = bare(text)
                digest = xxhash.xxh64_intdigest(rest.encode("utf-8", "surrogatepass"))
                hashes.append(digest - (1 << 64) * (digest >> 63))
                sizes.append(len(rest))
            strings = pa.list_(pa.string())
            columns = [
                batch.column("path"), batch.column("workspace"), pa.array(why, strings), pa.array(names, strings), pa.array(hashes, pa.int64()), pa.array(sizes, pa.int32()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["path", "workspace", "reasons", "names", "content_hash", "n_chars"])

    return source.mapInArrow(run, "path string, workspace string, reasons array<string>, names array<string>, content_hash long, n_chars int")


def _directory(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def _name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def merkle(files: DataFrame) -> DataFrame:
    """(workspace, path, directory boolean, node_hash long, depth int, n_files long, n_chars long) of each file and directory.

    Bottom-up: a directory's hash comes from the names and hashes of its entries, level by level. The number of levels is
    that of the deepest path; each level is one aggregation, and the levels grow smaller towards the roots.
    """
    depth = F.size(F.split("path", "/"))
    leaves = (
        files.groupBy("workspace", "path")
        .agg(F.max("content_hash").alias("node_hash"), F.max_by("n_chars", "content_hash").cast("long").alias("n_chars"))
        .select("workspace", "path", F.lit(False).alias("directory"), "node_hash", depth.alias("depth"), F.lit(1).cast("long").alias("n_files"), "n_chars")
    )
    leaves = checkpointed(leaves)
    deepest = leaves.agg(F.max("depth")).first()[0] or 0
    levels, below = [leaves], None
    for level in range(deepest, 2, -1):
        entries = leaves.where(F.col("depth") == level)
        entries = entries if below is None else entries.unionByName(below)
        entry = F.xxhash64(_name(F.col("path")), "node_hash")
        below = (
            entries.groupBy("workspace", _directory(F.col("path")).alias("path"))
            .agg(
                F.sum(F.shiftrightunsigned(entry, 16)).alias("sum"),
                F.bit_xor(entry).alias("xor"),
                F.count(F.lit(1)).alias("entries"),
                F.sum("n_files").alias("n_files"),
                F.sum("n_chars").alias("n_chars"),
            )
            .select(
                "workspace", "path", F.lit(True).alias("directory"), F.xxhash64("sum", "xor", "entries").alias("node_hash"),
                F.lit(level - 1).alias("depth"), "n_files", "n_chars",
            )
        )
        below = checkpointed(below)
        levels.append(below)
    tree = levels[0]
    for more in levels[1:]:
        tree = tree.unionByName(more)
    return tree


def origins(rows: DataFrame) -> DataFrame | None:
    """(workspace, origin long) of the workspaces that are checkouts or forks of one origin; None if there are none.

    Each file is compared with the first and the last workspace, by name, that has it at the same place, so there is no
    list of holders and no pair of workspaces but those; links are then followed to all of a family. What two have in
    common must be most of the smaller and not lie in one directory only, or be all of both.
    """
    place = F.expr("substring(path, length(workspace) + 2)")
    files = rows.where("workspace is not null and n_chars > 0").select("workspace", place.alias("place"), "content_hash").distinct()
    sizes = files.groupBy("workspace").agg(F.count(F.lit(1)).alias("size"))
    holders = files.groupBy("place", "content_hash").agg(F.min("workspace").alias("low"), F.max("workspace").alias("high")).where("low != high")
    met = files.join(holders, ["place", "content_hash"]).select(
        "workspace", F.explode(F.array_distinct(F.array("low", "high"))).alias("other"), F.substring_index("place", "/", 1).alias("top")
    )
    common = met.where("workspace != other").groupBy("workspace", "other").agg(F.count(F.lit(1)).alias("common"), F.min("top").alias("low"), F.max("top").alias("high"))
    # What lies in one directory alone may be a copied library, unless it is all there is.
    most = (F.col("common") >= F.least("size", "other_size") * F.lit(ONE_ORIGIN_FROM)) & (F.col("low") != F.col("high"))
    related = (
        common.join(sizes, "workspace")
        .join(sizes.select(F.col("workspace").alias("other"), F.col("size").alias("other_size")), "other")
        .where(most | (F.col("common") == F.greatest("size", "other_size")))
        .select(F.xxhash64("workspace").alias("a"), F.xxhash64("other").alias("b"))
    )
    related = checkpointed(related)
    if related.isEmpty():
        return None
    family = connected(related).toDF("number", "origin")
    return sizes.select("workspace", F.xxhash64("workspace").alias("number")).join(family, "number").select("workspace", "origin")


def shared_subtrees(tree: DataFrame, families: DataFrame | None = None) -> DataFrame:
    """(workspace, path, directory, origins long): files and directories with the same hash in unrelated workspaces.

    Those with little in them are no evidence: an empty or one-line file is the same in many trees. ``families`` are the
    workspaces of common origin.
    """
    tree = tree.where(F.col("n_chars") >= EVIDENCE_FROM)
    holders = tree.select("node_hash", "workspace").distinct()
    if families is None:
        holders = holders.withColumn("origin", F.xxhash64("workspace"))
    else:
        holders = holders.join(families, "workspace", "left").withColumn("origin", F.coalesce("origin", F.xxhash64("workspace")))
    spread_over = holders.groupBy("node_hash").agg(F.count_distinct("origin").alias("origins")).where("origins > 1")
    return tree.join(spread_over, "node_hash").select("workspace", "path", "directory", "origins")


def proven_names(rows: DataFrame) -> DataFrame:
    """(name): the conventional names that the corpus bears out. At most one row for each name of the fixed sets."""
    counts = rows.select(F.explode("names").alias("name"), (F.size("reasons") > 0).alias("own")).groupBy("name")
    share = F.count_if("own") / (F.count(F.lit(1)) + NAME_PRIOR)
    return counts.agg(share.alias("share")).where(F.col("share") >= NAME_FROM).select("name")


def not_hand_written(files: DataFrame) -> DataFrame:
    """(path, workspace, reasons array): each file that counts as generated, vendored, minified or data, with why."""
    rows = checkpointed(judged(files).distinct())
    shared = shared_subtrees(merkle(rows), origins(rows)).select("workspace", "path", "directory").distinct()
    # A file lies under each of its directories; only the shared ones, which are few, meet it.
    under = F.transform(
        F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(F.split("path", "/")))),
        lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"),
    )
    places = rows.select("path", "workspace", F.explode(under).alias("place"))
    copies = places.join(shared.select("workspace", F.col("path").alias("place")), ["workspace", "place"], "left_semi").select(
        "path", "workspace"
    )
    shared_files = copies.distinct().select("path", "workspace", F.lit("shared subtree").alias("why"))
    # A shared copy is evidence for the names of its directories, too.
    known = rows.join(shared_files, ["path", "workspace"], "left").select(
        "path", "workspace", "names", F.when(F.col("why").isNull(), F.col("reasons")).otherwise(F.array_append("reasons", F.col("why"))).alias("reasons")
    )
    known = checkpointed(known)
    named = known.select("path", "workspace", F.explode("names").alias("name")).join(F.broadcast(proven_names(known)), "name")
    why = known.select("path", "workspace", "reasons").union(named.select("path", "workspace", F.array(F.regexp_extract("name", "^[a-z]+ place", 0))))
    return (
        why.where(F.size("reasons") > 0)
        .groupBy("path", "workspace")
        .agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"))
    )
