"""Fixed values of the REST model service, shared by column expressions and clients."""

# --- fixed values: settings the service names otherwise, settings that never leave this program, the reply asked of the judge ---
SETTING_NAMES = {
    "max_output_tokens": "maxOutputTokens",
    "top_p": "topP",
    "top_k": "topK",
    "response_mime_type": "responseMimeType",
    "response_json_schema": "responseJsonSchema",
}
LOCAL_ONLY = ["prompt_version", "conservative", "require_following_step"]
DECISION_SCHEMA = {
    "type": "object",
    "properties": {
        "has_removal": {"type": "boolean"},
        "removed_start_index": {"type": ["integer", "null"]},
        "removed_end_index": {"type": ["integer", "null"]},
        "reason": {"type": "string"},
        "can_continue_after_skip": {"type": "boolean"},
    },
    "required": ["has_removal", "removed_start_index", "removed_end_index", "reason", "can_continue_after_skip"],
    "additionalProperties": False,
}
