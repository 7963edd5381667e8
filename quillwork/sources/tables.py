"""SRC-2: the table store. One schema per relation; rows are read as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMAS: dict[str, str] = {
    "sys_user": "id bigint, username string, role string, status smallint, created_at timestamp",
    "user_dir": "id bigint, user_id bigint, name string, created_at timestamp",
    "file_blob": "id bigint, file_hash string, file_size bigint, stored_name string, owner_user_id bigint, ref_count int",
    "user_file": "id bigint, user_id bigint, blob_id bigint, dir_id bigint, filename string, file_size bigint, "
                 "status smallint, owner_type string, org_id bigint, deleted_at timestamp, created_at timestamp",
    "parse_tasks": "file_id bigint, status string, stage string, progress float, attempt int, error string, "
                   "duration_ms int, node_count int, chunk_count int, updated_at timestamp",
    "rag_chunk": "id bigint, file_id bigint, chunk_type string, seq int, content string, chars int, "
                 "heading_path string, page_no int, embedding array<float>, embed_model string",
    "upload_session": "id bigint, user_id bigint, filename string, file_size bigint, file_hash string, "
                      "chunk_count int, status string, updated_at timestamp",
    "upload_chunk": "session_id bigint, chunk_index int, chunk_size bigint",
    "qa_session": "id string, user_id bigint, dir_id bigint, summary string, created_at timestamp",
    "qa_log": "id bigint, session_id string, user_id bigint, trace_id string, query string, answer string, "
              "route string, chunk_ids array<bigint>, total_ms int, token_in int, token_out int, "
              "thinking boolean, cache_hit boolean, created_at timestamp",
    "retrieval_log": "id bigint, user_id bigint, trace_id string, query string, hit_count int, top_score float, "
                     "low_confidence boolean, stage_ms map<string,double>, created_at timestamp",
    "qa_cache": "id bigint, user_id bigint, query_hash string, query string, query_embedding array<float>, "
                "answer string, chunk_ids array<bigint>, file_ids array<bigint>, cache_shared_from bigint, "
                "hit_count int, invalidated boolean, updated_at timestamp",
    "feedback": "id bigint, qa_log_id bigint, user_id bigint, rating smallint, correction string, created_at timestamp",
    "bad_case": "id bigint, qa_log_id bigint, user_id bigint, query string, snapshot string, attribution string, "
                "status string, created_at timestamp",
    "eval_question": "id bigint, question string, reference_answer string, dimension string, "
                     "in_regression boolean, meta string",
    "eval_run": "id bigint, name string, config string, metrics map<string,double>, created_at timestamp",
    "eval_result": "id bigint, run_id bigint, question_id bigint, scores map<string,double>, "
                   "retrieved_chunk_ids array<bigint>, answer string",
    "prompt_registry": "id bigint, code string, content string, version int, status smallint, updated_at timestamp",
    "prompt_approval": "id bigint, prompt_code string, new_content string, decision string, decided_at timestamp",
    "memory_entry": "id bigint, user_id bigint, mem_type string, content string, embedding array<float>",
    "issue_items": "id bigint, file_id bigint, page_no int, block_order int, block_type string, reason string, "
                   "bbox string, status string, resolution string, updated_at timestamp",
    "ingest_job": "id bigint, job_key string, user_id bigint, file_id bigint, status string, attempt int, "
                  "max_attempts int, lease_until timestamp, stage string, progress float, step_detail string, error string",
    "diagnosis_report": "id bigint, summary string, metrics string, created_at timestamp",
    "audit_log": "id bigint, user_id bigint, action string, target string, elapsed_ms bigint, created_at timestamp",
}


def load(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Read one relation with its fixed schema; unknown names are refused."""
    if name not in SCHEMAS:
        raise KeyError(f"no relation {name!r}")
    return spark.read.schema(SCHEMAS[name]).parquet(f"{root}/{name}")


def register(spark: SparkSession, root: str) -> None:
    """Expose every relation as a temporary view."""
    for name in SCHEMAS:
        load(spark, root, name).createOrReplaceTempView(name)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Hash rows by ``key`` when the files give few splits for the cores.

    Large inputs have splits enough and stay as they are; the rule only acts on a
    few files, whose splits may be empty as a row group is read by one task.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < 4 * cores else df
