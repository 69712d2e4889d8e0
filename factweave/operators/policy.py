"""Which files may be read, what an inventory says of files without facts, and whether files stayed as they were."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from factweave.functions.paths import basename

# Names and extensions of readable text, and of what is never read.
TEXT_EXTENSIONS = (
    ".c .cc .conf .cpp .cjs .cts .css .csv .go .h .hpp .html .java .js .json .jsx .kt .kts .md .mjs .mts .mm .py .pyi .prisma "
    ".rb .rs .sh .sql .swift .toml .ts .tsx .txt .wxml .xml .yaml .yml"
).split()
TEXT_NAMES = "go.mod go.work setup.cfg build.gradle settings.gradle".split()
BARE_NAMES = "dockerfile gemfile license makefile procfile readme".split()
SENSITIVE_FOLDERS = ".git .ssh .aws .gnupg .docker .kube .azure".split()
SENSITIVE_PATHS = [".config/gcloud", ".config/gh", ".config/glab-cli", ".cargo/credentials.toml"]
SENSITIVE_NAMES = ".netrc _netrc .npmrc .pypirc credentials credentials.json application_default_credentials.json service_account.json id_rsa id_ed25519 .env".split()
SENSITIVE_EXTENSIONS = ".key .pem .p12 .pfx .cer .crt".split()
SKIPPED_FOLDERS = [".local"]
CONFIG_NAMES = "package.json tsconfig.json go.mod go.work pyproject.toml setup.cfg build.gradle settings.gradle pom.xml".split()


def extension(name: Column) -> Column:
    """From the last dot on; a leading dot begins a name, no extension."""
    return F.regexp_extract(name, r"^.+(\.[^.]*)$", 1)


def is_restricted(path: Column) -> Column:
    """Secrets, version control and databases: never read, whatever the extension."""
    lower = F.lower(path)
    name = basename(lower)
    out = F.arrays_overlap(F.split(lower, "/"), F.array(*map(F.lit, SENSITIVE_FOLDERS)))
    for part in SENSITIVE_PATHS:
        out = out | F.concat(F.lit("/"), lower, F.lit("/")).contains(f"/{part}/")
    named = name.isin(*SENSITIVE_NAMES) | name.startswith(".env.") | extension(name).isin(*SENSITIVE_EXTENSIONS)
    return out | named | name.endswith(".sqlite") | name.contains(".sqlite-")


def is_skipped(path: Column) -> Column:
    """Below a folder that a listing does not enter."""
    return F.arrays_overlap(F.split(F.lower(path), "/"), F.array(*map(F.lit, SKIPPED_FOLDERS)))


def is_text_path(path: Column) -> Column:
    name = basename(F.lower(path))
    ext = extension(name)
    return name.isin(*TEXT_NAMES) | F.when(ext == "", name.isin(*BARE_NAMES)).otherwise(ext.isin(*TEXT_EXTENSIONS))


def read_policy(path: Column) -> Column:
    """RESTRICTED, SKIPPED, READABLE or OTHER; a restriction comes before all else."""
    return F.when(is_restricted(path), "RESTRICTED").when(is_skipped(path), "SKIPPED").when(is_text_path(path), "READABLE").otherwise("OTHER")


def inventory(files: DataFrame, objects: DataFrame) -> DataFrame:
    """path, kind, gap of text files that no object lies in: an object of their own, and the gap that says why.

    files: path, entry_state. Manifests are CONFIG, all else FILE.
    """
    bare = files.filter("entry_state = 'TEXT'").join(objects.select("path").distinct(), "path", "left_anti")
    kind = F.when(basename(F.lower(F.col("path"))).isin(*CONFIG_NAMES), "CONFIG").otherwise("FILE")
    return bare.select("path", kind.alias("kind"), F.lit("NOT_IN_PARSED_CONTEXT").alias("gap"))


def moved_since(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """path, reason of files whose state, digest or length is no longer what was captured, and of those gone or new."""
    e = expected.select("path", F.struct("entry_state", "content_digest", "byte_length").alias("was"))
    a = actual.select("path", F.struct("entry_state", "content_digest", "byte_length").alias("is"))
    both = e.join(a, "path", "full_outer").filter(~F.col("was").eqNullSafe(F.col("is")))
    return both.select("path", F.when(F.col("is").isNull(), "GONE").when(F.col("was").isNull(), "NEW").otherwise("CHANGED").alias("reason"))
