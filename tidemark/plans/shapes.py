"""Record shapes: rows to the nested records that training, inference and evaluation files hold."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.labels import as_map

#: What a prediction record says of itself.
NOTE = "Generated from the user turn alone; assistant turns were left out."
RETRIED = " Asked once more with a larger budget."


def wire(shots: Column) -> Column:
    """Shots (s, e, description, explanation, b) as an array with the wire form's names."""
    return F.transform(
        shots,
        lambda x: F.struct(x["s"].alias("START_SEC"), x["e"].alias("END_SEC"), x["description"].alias("DESCRIPTION"), as_map(x["b"]).alias("GUARDRAIL"), x["explanation"].alias("EXPLANATION")),
    )


def answer(shots: Column) -> Column:
    """The shots as JSON text of the wire form."""
    return F.to_json(wire(shots))


def _turn(who: str, value: Column) -> Column:
    return F.struct(F.lit(who).alias("from"), value.alias("value"))


def conversation(prompt: Column, reply: Column, video: Column) -> tuple[Column, Column]:
    """(messages, conversations): both dialects. The user's content is JSON text of its parts, as its parts differ in kind."""
    parts = F.to_json(F.array(F.struct(F.lit("video").alias("type"), video.alias("video"), F.lit(None).cast("string").alias("text")), F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("video"), prompt.alias("text"))))
    said = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    return F.array(said("user", parts), said("assistant", reply)), F.array(_turn("human", F.concat(F.lit("<video>\n"), prompt)), _turn("gpt", reply))


def shot_counts(shots: Column) -> list[Column]:
    n, bad = F.size(shots), F.size(F.filter(shots, lambda x: x["b"] != 0))
    return [bad.alias("num_violations"), n.alias("num_shots"), bad.alias("num_harmful_shots"), (n - bad).alias("num_benign_shots")]


def training_record(sample: Column, task: str, video: Column, relative: Column, prompt: Column, shots: Column, duration: Column, category: Column) -> Column:
    reply = answer(shots)
    messages, turns = conversation(prompt, reply, video)
    metadata = F.struct(relative.alias("video_relative_path"), F.round(duration, 3).alias("duration_sec"), *shot_counts(shots), category.alias("source_category"))
    return F.struct(sample.alias("id"), F.lit(task).alias("task_name"), video.alias("video"), F.array(video).alias("videos"), messages.alias("messages"), turns.alias("conversations"), metadata.alias("metadata"))


def inserted_record(
    sample: Column, task: str, video: Column, relative: Column, prompt: Column, shots: Column, duration: Column, safe_video: Column, harmful_video: Column, domain: Column, category: Column, subcategory: Column
) -> Column:
    """As training_record, with where the inserted clip came from and where its first harmful interval lies."""
    made = training_record(sample, task, video, relative, prompt, shots, duration, F.concat_ws("_", F.lit("inserted"), domain, category, subcategory))
    first = F.get(F.filter(shots, lambda x: x["b"] != 0), 0)
    more = {
        "safe_source_video": safe_video, "harmful_source_video": harmful_video, "harmful_source_domain": domain, "harmful_source_category": category,
        "harmful_source_subcategory": subcategory, "insert_start_sec": F.round(first["s"], 3), "insert_end_sec": F.round(first["e"], 3),
    }
    metadata = made["metadata"]
    for k, v in more.items():
        metadata = metadata.withField(k, v)
    return made.withField("metadata", metadata)


def image_record(record: Column, prompt: Column, images: Column, folder: Column) -> Column:
    """A record (id, video, conversations, metadata: map) on frames instead of its video."""
    tokens = F.array_join(F.array_repeat(F.lit("<image>"), F.size(images)), " ")
    asked = F.when(F.coalesce(prompt, F.lit("")) == "", tokens).otherwise(F.concat(tokens, F.lit("\n"), prompt))
    new = F.create_map(F.lit("frame_dir"), folder, F.lit("num_frames"), F.size(images).cast("string"), F.lit("source_video"), record["video"])
    old = F.coalesce(record["metadata"], F.create_map().cast("map<string,string>"))
    metadata = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    return F.struct(record["id"].alias("id"), images.alias("images"), F.array(_turn("human", asked), _turn("gpt", F.get(record["conversations"], 1)["value"])).alias("conversations"), metadata.alias("metadata"))


def raw_output_record(
    index: Column, source: Column, record: Column, prompt: Column, raw: Column, payload: Column, shots: Column, error: Column, retried: Column, folder: Column | None = None, n_frames: Column | None = None, url: Column | None = None
) -> Column:
    some = lambda c, t: F.lit(None).cast(t) if c is None else c
    return F.struct(
        index.alias("jsonl_record_index"), source.alias("source_jsonl"), record["id"].alias("id"), record["video"].alias("video"), some(folder, "string").alias("frames_dir"), some(n_frames, "int").alias("num_frames"),
        some(url, "string").alias("request_video_url"), prompt.alias("prompt"), raw.alias("raw_output"), F.coalesce(wire(shots), F.array().cast("array<struct<START_SEC:double,END_SEC:double,DESCRIPTION:string,GUARDRAIL:map<string,boolean>,EXPLANATION:string>>")).alias("prediction_intervals"),
        payload.alias("prediction_interval_payload"), error.alias("parse_error"), retried.alias("used_retry"),
    )


def baseline_record(index: Column, source: Column, record: Column, raw: Column, payload: Column, gt_text: Column, gt_payload: Column, retried: Column, note: str = NOTE, more: str = RETRIED) -> Column:
    """An evaluation record of iteration 0."""
    prediction = F.struct(raw.alias("supervised_span_text"), F.when(retried, note + more).otherwise(note).alias("note"), payload.alias("intervals"))
    return F.struct(
        F.lit(0).alias("iteration"), F.lit(0).alias("consumed_train_samples"), index.alias("jsonl_record_index"), source.alias("gt_jsonl"), record.alias("gt_record"), prediction.alias("prediction"),
        F.struct(gt_text.alias("supervised_span_text"), gt_payload.alias("intervals")).alias("ground_truth"),
    )


def prediction_record(record: Column, relative: Column, folder: Column, n_frames: Column, raw: Column, error: Column, gt: Column, pred: Column) -> Column:
    """A prediction beside its ground truth, with the label codes of either side."""
    from tidemark.functions.labels import codes
    from tidemark.operators.compare import label_union

    named = lambda shots: F.filter(F.split(codes(label_union(shots)), ","), lambda c: c != "")
    return F.struct(
        record["id"].alias("id"), record["video"].alias("video"), relative.alias("video_relative_path"), folder.alias("frames_dir"), n_frames.alias("num_frames"), raw.alias("raw_output"), error.alias("parse_error"),
        named(gt).alias("gt_categories"), named(pred).alias("pred_categories"), gt.alias("gt_shots"), pred.alias("pred_shots"),
    )
