"""Table layouts. A form is long: one row for each field, so forms of any shape share one table. A form without fields is one row whose name is null."""

from __future__ import annotations

FORM_FIELDS = "file string, field_ordinal int, field_name string, field_type string, options array<string>, text_value string, checked boolean, selected array<string>, read_error string"
FIELD_TYPES = ("text", "checkbox", "radio", "dropdown", "unknown")
VALUES = "row long, ordinal int, field_name string, value string, value_kind string"
EXTRACT_NAME = "_filename"
