"""Schemas of the persisted tables, for readers that shouldn't infer them."""

PROJECTS = "id bigint, name string, source_type string, source string, project_path string, snapshot_id string, stats_json string, chunks_json string, consent_json string, created_at timestamp"
QUESTIONS = (
    "id bigint, project_id bigint, slot string, stem string, options_json string, answer_json string, justifications_json string, evidence_json string, alignment_json string, "
    "assessment_point_ids_json string, difficulty int, focus_areas_json string, explanation string, status string, generator string, flags_json string, confidence int, created_at timestamp"
)
ASSESSMENTS = "id bigint, project_id bigint, title string, token string, question_ids_json string, config_json string, status string, created_at timestamp"
ATTEMPTS = "id bigint, assessment_id bigint, taker_name string, repo_id string, responses_json string, score_json string, research_opt_in boolean, submitted_at timestamp"
EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"
