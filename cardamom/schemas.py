"""Schemas of cards, annotations, cases and calls. They are closed: always given, never inferred."""

VIOLATION = "struct<rule_id: string, severity: string, field_path: string, quote: string, rationale: string>"
IMAGE_VIOLATION = "struct<rule_id: string, severity: string, image_id: string, evidence: string, rationale: string, field_path: string>"
CARD = (
    "struct<id: string, product_type: string, title: string, short_description: string, full_description: string,"
    " program_items: array<struct<order: int, title: string, description: string>>, services: array<struct<name: string, description: string>>,"
    " location: struct<address: string, route_comment: string, meeting_point_comment: string>, contacts_block: struct<public_comment: string>,"
    " schedule: struct<format: string, dates: array<string>, duration_minutes: int>, age_restriction: string, group_size: struct<min: int, max: int>,"
    " languages: array<string>, images: array<struct<image_id: string, role: string, caption: string>>>"
)
CARD_RECORD = f"card {CARD}, _meta struct<source_site: string, source_url: string, fetched_at: string, parser_version: string, json_ld_found: boolean, warnings: array<string>>"
IMAGE_RECORD = "image_id string, linked_card_id string, role string, caption string, source_url string, file_path string, _meta struct<queued_at: string>"
ANNOTATION = f"struct<expected_clean: boolean, violations: array<{VIOLATION}>, notes: string, annotated_at: string, annotator: string, expected_image_clean: boolean, image_violations: array<{IMAGE_VIOLATION}>>"
STORE = f"version int, annotations map<string, {ANNOTATION}>"
CASE = (
    f"case_id string, kind string, source string, generator struct<model: string, prompt_version: string, date: string>, card {CARD},"
    f" expected_violations array<{VIOLATION}>, expected_clean boolean, expected_image_clean boolean, expected_image_violations array<{IMAGE_VIOLATION}>, notes string"
)
RULE = "id string, severity string, category string, title string, description string"
CALL = "provider string, model string, case_id string, run int, output string, error string, prompt_tokens long, completion_tokens long, cost double, latency_ms long, cached boolean"

#: Severities, the worst last.
SEVERITY_RANK = {"low": 1, "medium": 2, "high": 3, "critical": 4}
