"""Declared schemas of the authority tables, the logs and the plug-in inputs."""

from __future__ import annotations

from pyspark.sql import types as T

IDENTIFIER = "struct<scheme:string,value:string,normalized_value:string,mention:string,confidence:double>"
CLAIM = "struct<attribute:string,value:string,normalized_value:string,confidence:double>"
LOCATOR = ("struct<page:int,time_range:struct<start:double,end:double>,cell_range:string,"
           "bbox:struct<x0:double,y0:double,x1:double,y1:double>>")
ATTACHMENT = "struct<name:string,mime_type:string,size:bigint>"

PAYLOAD_BRANCHES = {
    "knowledge": "subject:string,predicate:string,object:string,qualifiers:map<string,string>,temporal_scope:string",
    "preference": "preferred_behavior:string,applicability_conditions:array<string>,strength:double,consent:boolean",
    "solution": ("problem_signature:string,environment:map<string,string>,steps:array<string>,outcome:string,"
                 "verification_evidence:array<string>"),
    "entity": ("canonical_name:string,entity_type:string,aliases:array<string>,"
               "external_ids:map<string,string>,graph_links:array<string>"),
    "event": ("event_type:string,event_type_raw:string,summary:string,entities:array<string>,"
              f"locations:array<string>,temporal_scope:string,identifier_references:array<{IDENTIFIER}>,"
              f"claims:array<{CLAIM}>"),
}
PAYLOAD = "struct<" + ",".join(f"{kind}:struct<{body}>" for kind, body in PAYLOAD_BRANCHES.items()) + ">"

_DDL = {
    "sessions": ("session_id string, owner_id string, title string, project_scope string, project_id string,"
                 " created_at timestamp, updated_at timestamp"),
    "session_messages": ("message_id string, session_id string, turn_index int, trace_id string, role string,"
                         f" content string, attachments array<{ATTACHMENT}>, created_at timestamp"),
    "projects": ("project_id string, owner_id string, name string, normalized_name string, created_at timestamp,"
                 " updated_at timestamp, archived_at timestamp"),
    "project_memberships": "project_id string, owner_id string, role string, created_at timestamp",
    "memory_records": ("memory_id string, subject_id string, owner_id string, scope string, session_id string,"
                       " project_id string, project_scope string, kind string, status string, confidence double,"
                       " user_confirmed boolean, evidence_refs array<string>, source_turn_id string,"
                       " extraction_model string, extraction_version string, identity_key string,"
                       " valid_from timestamp, valid_to timestamp, superseded_by string,"
                       f" payload {PAYLOAD}, created_at timestamp, updated_at timestamp"),
    "memory_audit_events": ("event_id bigint, memory_id string, event_type string, actor_id string,"
                            " details string, created_at timestamp"),
    "memory_access_events": ("access_event_id bigint, trace_id string, session_id string, message_id string,"
                             " memory_id string, event_type string, prompt_label string, rank int, score double,"
                             " details string, created_at timestamp"),
    "memory_extractions": ("source_turn_id string, extraction_version string, status string, error string,"
                           " created_at timestamp, updated_at timestamp"),
    "memory_relationships": ("relationship_id bigint, from_memory_id string, to_memory_id string,"
                             " relationship_type string, source string, conflict_id bigint, created_by string,"
                             " details string, created_at timestamp"),
    "memory_conflicts": ("conflict_id bigint, incoming_memory_id string, existing_memory_id string,"
                         " conflict_type string, status string, details string, resolved_by string,"
                         " resolution string, created_at timestamp, resolved_at timestamp"),
    "memory_projection_jobs": ("job_id string, memory_id string, target string, status string, attempts int,"
                               " error string, locked_at timestamp, locked_by string, created_at timestamp,"
                               " updated_at timestamp"),
    "memory_identifier_references": ("memory_id string, scheme string, normalized_value string, raw_value string,"
                                     " mention string, confidence double, created_at timestamp"),
    "memory_subjects": ("subject_id string, owner_id string, scope string, scope_key string, subject_kind string,"
                        " created_at timestamp, updated_at timestamp"),
    "memory_subject_identifiers": ("subject_id string, owner_id string, scope string, scope_key string,"
                                   " scheme string, normalized_value string, raw_value string, confidence double,"
                                   " created_at timestamp"),
    "assets": ("asset_id string, filename string, media_type string, raw_file_uri string, content_hash string,"
               " created_at timestamp"),
    "asset_bindings": ("binding_id bigint, asset_id string, owner_id string, scope string, session_id string,"
                       " project_id string, created_at timestamp"),
    "ingestion_runs": ("run_id string, asset_id string, binding_id bigint, modality string, status string,"
                       " chunk_count int, error string, parser_backend string, parser_version string,"
                       " created_at timestamp, started_at timestamp, completed_at timestamp"),
    "evidence_segments": ("evidence_id string, asset_id string, modality string, representation string,"
                          f" content string, media_uri string, source_name string, locator {LOCATOR},"
                          " parent_evidence_id string, parser_backend string, parser_version string,"
                          " retrieval_metadata map<string,string>, content_hash string, created_at timestamp"),
    "evidence_projection_jobs": ("job_id string, evidence_id string, binding_id bigint, target string, status string,"
                                 " attempts int, error string, locked_at timestamp, locked_by string,"
                                 " created_at timestamp, updated_at timestamp"),
    "latency_log": ("duration_ms double, outcome string, pipeline string, stage string, run_id string,"
                    " trace_id string, binding_id bigint, job_count bigint"),
    # Inputs a user supplies where the decision comes from a model.
    "memory_plans": ("turn_id string, selected_memory_ids array<string>,"
                     " relationships array<struct<memory_id:string,relation:string,confidence:double>>,"
                     " rationale string"),
    "reconciliation_decisions": ("memory_id string, outcome string, existing_memory_id string,"
                                 " matched_identifier_values array<string>,"
                                 " changed_claims map<string,struct<existing:string,incoming:string>>,"
                                 " confidence double, reason string"),
    "subquery_plans": "query_id string, subqueries array<string>",
    "extraction_candidates": ("source_turn_id string, kind string, confidence double, evidence_refs array<string>,"
                              " payload string"),
    "conversation_cases": ("id string, turns array<struct<role:string,content:string>>,"
                           " expected map<string,string>"),
}


def schema(table: str) -> T.StructType:
    """Schema of one table, by name."""
    return T.StructType.fromDDL(_DDL[table])


def table_names() -> list[str]:
    return list(_DDL)
