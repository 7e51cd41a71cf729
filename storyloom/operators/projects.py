"""Saved scripts, dataset builder projects and exports, as functions from tables to their next version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storyloom.functions import text as T
from storyloom.operators import timeline


def save_scripts(store: DataFrame, current: DataFrame) -> DataFrame:
    """The store (script_name, pos, speaker, text, instruct) in which every script of ``current`` replaces the one of its
    name. Names are cleaned; scripts whose name has nothing left are not saved. Two of one name are one script: the
    caller names them apart."""
    named = current.withColumn("script_name", T.project_name(F.col("script_name"))).filter("script_name <> ''")
    return store.join(named.select("script_name").distinct(), "script_name", "left_anti").unionByName(named.select(*store.columns))


def load_script(store: DataFrame, configs: DataFrame, names: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries of the named scripts by book, voice configuration by book): ``names`` has book_id and script_name. A
    script that is saved without a configuration keeps the ``current`` one (book_id, speaker, type) of its book; a
    name that is not saved gives nothing. Chunks of the books are to be reset."""
    entries = names.join(store, "script_name").select("book_id", "pos", "speaker", "text", "instruct")
    there = names.join(store.select("script_name").distinct(), "script_name", "left_semi")
    with_own = there.join(configs.select("script_name").distinct(), "script_name", "left_semi")
    own = with_own.join(configs, "script_name").select("book_id", "speaker", "type")
    return entries, own.unionByName(current.join(with_own.select("book_id"), "book_id", "left_anti").select("book_id", "speaker", "type"))


def delete_named(rows: DataFrame, names: DataFrame, key: str = "script_name") -> DataFrame:
    """Without the scripts (or, by another key, projects) of these names; to be applied to the store and to what lies
    beside it, such as voice configurations."""
    return rows.join(names.select(key), key, "left_anti")


def script_list(store: DataFrame, configs: DataFrame) -> DataFrame:
    """(script_name, n_entries, has_voice_config) of all saved scripts."""
    has = configs.select("script_name", F.lit(True).alias("c")).distinct()
    got = store.groupBy("script_name").agg(F.count("*").alias("n_entries")).join(has, "script_name", "left")
    return got.select("script_name", "n_entries", F.coalesce("c", F.lit(False)).alias("has_voice_config"))


def create_projects(projects: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(projects (name, description, global_seed) with an empty one for every new cleaned name, what became of every
    asked name): ``created``, ``exists`` or, where nothing is left of the name, ``invalid``."""
    asked = names.select(F.col("name").alias("asked"), T.project_name(F.col("name")).alias("name")).distinct()
    old = projects.select("name", F.lit(True).alias("old"))
    fate = asked.join(old, "name", "left").select("asked", "name", F.when(T.text_of(F.col("name")) == "", "invalid").when(F.col("old"), "exists").otherwise("created").alias("fate"))
    new = fate.filter("fate = 'created'").select("name").distinct().select("name", F.lit("").alias("description"), F.lit("").alias("global_seed"))
    return projects.unionByName(new), fate


def update_meta(projects: DataFrame, changes: DataFrame) -> DataFrame:
    """Projects with the description and seed of ``changes`` (name, description, global_seed), which do not touch samples;
    changes of unknown projects count for nothing."""
    new = changes.select("name", F.struct("description", "global_seed").alias("new"))
    t = projects.join(new, "name", "left")
    pick = lambda f: F.when(F.col("new").isNotNull(), F.col(f"new.{f}")).otherwise(F.col(f)).alias(f)
    return t.select("name", pick("description"), pick("global_seed"))


def save_datasets(samples: DataFrame, requests: DataFrame, present: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metadata rows (name, idx, audio_filepath, text, ref_audio), outcome (name, outcome, sample_count, ref_idx, ref_text)).

    ``requests`` has name and ref_index, ``present`` the names of datasets that there are. Done samples (name, idx, text,
    status) of a project become a dataset, with the asked one as reference if it is done, else the first; a project
    without any is ``empty`` or, if it has no samples at all, ``missing``, and a dataset that is there is ``exists``.
    """
    done = samples.filter("status = 'done'")
    asked = requests.select("name", "ref_index")
    ref = done.join(asked, "name").groupBy("name").agg(F.min_by(F.struct("idx", "text"), F.struct((F.col("idx") != F.col("ref_index")).alias("o"), "idx")).alias("ref"), F.count("*").alias("n"))
    known = samples.select("name", F.lit(True).alias("known")).distinct()
    there = present.select("name", F.lit(True).alias("there")).distinct()
    t = asked.join(known, "name", "left").join(ref, "name", "left").join(there, "name", "left")
    fate = F.when(F.col("known").isNull(), "missing").when(F.col("n").isNull(), "empty").when(F.col("there"), "exists").otherwise("saved")
    outcome = t.select("name", fate.alias("outcome"), F.when(fate == "saved", F.col("n")).alias("sample_count"), F.when(fate == "saved", F.col("ref.idx")).alias("ref_idx"), F.when(fate == "saved", F.col("ref.text")).alias("ref_text"))
    rows = done.join(outcome.filter("outcome = 'saved'").select("name"), "name", "left_semi")
    return rows.select("name", "idx", F.format_string("sample_%03d.wav", "idx").alias("audio_filepath"), "text", F.lit("ref.wav").alias("ref_audio")), outcome


def export_files(line: DataFrame) -> DataFrame:
    """(book_id, file, content) of a book's export: the track list, the labels, and for each speaker's track the silence
    and the chunk of every piece, one per line. A track file is named as in the track list; speakers of one file name
    share it. ``line`` is a timeline."""
    lof = timeline.track_list(line).select("book_id", F.lit("project.lof").alias("file"), "content")
    lines = lambda order, text: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text.alias("t")))), lambda x: F.concat(x["t"], F.lit("\n"))), "").alias("content")
    labels = timeline.label_lines(line).groupBy("book_id").agg(lines("id", F.col("label"))).select("book_id", F.lit("labels.txt").alias("file"), "content")
    piece = F.format_string("%d\t%d\t%d", "gap_ms", "id", "dur_ms")
    tracks = timeline.tracks(line).withColumn("file", F.concat(T.file_stem(F.col("speaker")), F.lit(".wav"))).groupBy("book_id", "file").agg(lines("id", piece))
    return lof.unionByName(labels).unionByName(tracks.select("book_id", "file", "content"))
