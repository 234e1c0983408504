"""Schemas of the inventory's tables. Lists of the domain carry their order in the column ord."""

from __future__ import annotations




FILE_RECORD = (
    "uuid7 string, path string, source string, size long, mtime double, mode int, hash_algorithm string, blake3 string, category string, "
    "mime_type string, shortcut_allowed boolean, sha256 string, source_id string, source_type string, source_label string, source_device_uuid string"
)
RECORD_KEYS = ("uuid7", "path", "blake3", "category", "mime_type")
MANIFEST = f"source string, generated_at string, source_id string, source_type string, source_label string, source_device_uuid string, records array<struct<{FILE_RECORD.replace(' string', ':string').replace(' long', ':long').replace(' double', ':double').replace(' int', ':int').replace(' boolean', ':boolean')}>>"
FILE_INSTANCE = (
    "ord long, instance_id string, canonical_id string, version_id string, source_id string, provider string, path string, content_hash string, size long, "
    "mime_type string, modified_at string, discovered_at string, deleted_at string, device_id string"
)
DELTA_EVENT = (
    "ord long, provider_id string, event_type string, source_id string, path string, content_hash string, size long, mime_type string, modified_at string, "
    "previous_path string, device_id string"
)
MOVE_EVENT = (
    "event_id string, canonical_id string, instance_id string, event_type string, content_hash string, from_provider string, from_path string, from_device_id string, "
    "to_provider string, to_path string, to_device_id string"
)
FILE_VERSION = "ord long, version_id string, canonical_id string, parent_version_id string, content_hash string, size long, provider string, path string, created_at string"
SYNC_STATE = "provider_id string, strategy string, cursor string, last_sync_at string, last_error string, retries int"
FINGERPRINT = "ord long, file_id string, canonical_file_id string, a_hash string, d_hash string, p_hash string, embedding array<double>"
AUDIT_EVENT = "session_id string, seq long, event_id string, timestamp_uuid7 string, content_hash string, frame_id string, previous_event_hash string, event_hash string, created_at string"
MESSAGE = (
    "message_id string, source_platform string, source_workspace string, source_channel string, source_message_id string, author_id string, role string, "
    "body_text string, created_at timestamp, ingested_at timestamp"
)
# The legal names of source types and of delta events.
SOURCE_TYPES = ("local", "windows", "wsl", "external", "network", "gdrive", "onedrive", "dropbox", "provider")
EVENT_TYPES = ("new", "modified", "deleted", "moved", "renamed")


def empty(spark, ddl: str):
    return spark.createDataFrame([], ddl)
