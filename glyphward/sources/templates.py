"""Templates: the packs' own and those a user keeps as Markdown files with a header."""

from __future__ import annotations

import os
import re
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphward.functions.text import let, regex, strip
from glyphward.operators.registry import list_packs

ROOT_VARIABLE = "GLYPHWARD_TEMPLATES"
OWN_CATEGORY = "personal"
TEMPLATE = "pack string, id string, title string, category string, description string, body string"


def templates_df(spark: SparkSession) -> DataFrame:
    """The built-in templates."""
    return spark.createDataFrame([(p.name, t.id, t.title, t.category, t.description, t.body) for p in list_packs() for t in p.templates], TEMPLATE)


def prompts_df(spark: SparkSession) -> DataFrame:
    """The default pack's templates in the older form: prompt for body, and empty tags."""
    rows = templates_df(spark).where(F.col("pack") == list_packs()[0].name).drop("pack")
    return rows.withColumnRenamed("body", "prompt").withColumn("tags", F.array().cast("array<string>"))


def template_by_id(spark: SparkSession, template_id: str) -> DataFrame:
    """A row, or none."""
    return prompts_df(spark).where(F.col("id") == template_id)


def slugify(title: Column) -> Column:
    """Lower case with single hyphens for all but a-z and 0-9; untitled if nothing is left."""
    low = F.regexp_replace(F.lower(strip(title)), "[_ ]", "-")
    joined = F.regexp_replace(F.regexp_replace(low, "[^a-z0-9-]+", "-"), "-{2,}", "-")
    return F.coalesce(F.nullif(F.regexp_replace(joined, "^-+|-+$", ""), F.lit("")), F.lit("untitled"))


def slug(title: str) -> str:
    """As :func:`slugify`, of one string on the driver."""
    return re.sub("[^a-z0-9]+", "-", title.strip().lower()).strip("-") or "untitled"


HEADER = regex(r"\A---\n([\s\S]*?)\n---\n+([\s\S]*)\z")


def header(text: Column) -> Column:
    """map of the ``key: value`` lines between the opening dashes; empty without them. The last of equal keys counts."""
    lines = F.split(F.regexp_extract(text, HEADER, 1), r"\r\n|[\n\r]", -1)
    kept = F.filter(lines, lambda x: ~x.startswith("#") & x.contains(":"))

    def pair(line: Column) -> Column:
        key = F.lower(strip(F.substring_index(line, ":", 1)))
        value = strip(F.regexp_replace(line, r"^[^:]*:", ""))
        bare = F.when(value.rlike(r"^([\"']).*\1$"), F.regexp_replace(value, r"^.|.$", "")).otherwise(value)
        return F.struct(key.alias("key"), bare.alias("value"))

    pairs = F.transform(kept, pair)
    last = let(pairs, lambda ps: F.filter(ps, lambda p, i: ~F.exists(F.slice(ps, i + 2, F.size(ps)), lambda q: q["key"] == p["key"])))
    return F.map_from_entries(last)


def body(text: Column) -> Column:
    """What follows the header."""
    return F.when(text.rlike(HEADER), F.regexp_extract(text, HEADER, 2)).otherwise(text)


def title_of(text: Column, stem: Column) -> Column:
    """The header's title, else the first top heading, else the file's name."""
    named = F.nullif(F.element_at(header(text), F.lit("title")), F.lit(""))
    first = F.nullif(strip(F.regexp_extract(body(text), regex(r"(?m)^#\s+(.+)$"), 1)), F.lit(""))
    return F.coalesce(named, first, F.initcap(F.replace(stem, F.lit("-"), F.lit(" "))))


def parse_templates(files: DataFrame) -> DataFrame:
    """(id, title, category, description, body) of files with columns stem and text."""
    text = F.col("text")
    held = header(text)
    return files.select(
        *(c for c in files.columns if c not in ("text", "stem")),
        F.concat(F.lit("user:"), "stem").alias("id"),
        title_of(text, F.col("stem")).alias("title"),
        F.coalesce(F.element_at(held, F.lit("category")), F.lit(OWN_CATEGORY)).alias("category"),
        F.coalesce(F.element_at(held, F.lit("description")), F.lit("")).alias("description"),
        strip(body(text)).alias("body"),
    )


def templates_root() -> Path:
    if own := os.environ.get(ROOT_VARIABLE):
        return Path(own).expanduser()
    base = os.environ.get("XDG_CONFIG_HOME")
    return (Path(base) if base else Path.home() / ".config") / "glyphward" / "templates"


def user_templates(spark: SparkSession, pack: str, root: str | None = None) -> DataFrame:
    """(modified, id, title, category, description, body): a pack's files, the latest first; no rows without the folder."""
    folder = f"{root or templates_root()}/{pack}"
    if "://" not in folder and not list(Path(folder).glob("*.md")):
        return spark.createDataFrame([], "modified timestamp, id string, title string, category string, description string, body string")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folder)
    named = files.select(F.col("modificationTime").alias("modified"), F.regexp_extract(F.url_decode("path"), r"([^/]+)\.md$", 1).alias("stem"), F.decode("content", "UTF-8").alias("text"))
    return parse_templates(named).orderBy(F.col("modified").desc())


@dataclass(frozen=True)
class Saved:
    path: Path
    title: str
    overwrote: bool


def save_user_template(pack: str, title: str, text: str, category: str = OWN_CATEGORY, description: str = "", overwrite: bool = False, root: Path | None = None) -> Saved:
    """Write a file; ValueError for a blank title or body, FileExistsError if it is there already."""
    title = title.strip()
    if not title or not text.strip():
        raise ValueError("a template needs a title and a body")
    path = (root or templates_root()) / pack / f"{slug(title)}.md"
    there = path.exists()
    if there and not overwrite:
        raise FileExistsError(str(path))
    fields = {"title": title, "category": category if category != OWN_CATEGORY else "", "description": description}
    lines = "\n".join(f"{k}: {v}" for k, v in fields.items() if v)
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(f"---\n{lines}\n---\n\n{text.strip()}\n", encoding="utf-8")
    return Saved(path, title, there)


def template_exists(pack: str, title: str, root: Path | None = None) -> bool:
    return ((root or templates_root()) / pack / f"{slug(title)}.md").exists()


def prefill_title(text: Column) -> Column:
    """A title for a new template: the first line without leading hashes, 60 characters at most."""
    return F.substring(strip(F.regexp_replace(F.substring_index(strip(text), "\n", 1), "^#+", "")), 1, 60)

