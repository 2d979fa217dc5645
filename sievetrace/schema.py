"""Schemas of the record types."""

from __future__ import annotations

SEEDS = (
    "theorem_name string, theorem_statement string, file_path string, `commit` string, repo_url string, initial_state string, full_name string, "
    "theorem_pos map<string,int>, dojo_metadata map<string,string>, imports array<string>, template string, placeholder string, "
    "metadata struct<pattern_family:string,expected_success_tactics:array<string>>"
)
CANDIDATES = "theorem_name string, state_before string, candidates array<string>, source string, prompt_style string, metadata map<string,string>"
TRACES = (
    "theorem_name string, theorem_statement string, state_before string, tactic string, state_after string, success boolean, proof_finished boolean, "
    "num_goals_before int, num_goals_after int, state_changed boolean, error string, timeout boolean, source string, model string, backend string, "
    "prompt_style string, temperature double, `timestamp` string, raw_llm_output string, step_index int, parent_state_hash string, metadata map<string,string>"
)
#: Keys that a trace must hold; ``state_after`` may be null but not absent.
TRACE_KEYS = ("theorem_name", "theorem_statement", "state_before", "tactic", "state_after", "success", "proof_finished")
#: Keys of a seed record, of which no others are allowed.
SEED_KEYS = ("theorem_name", "theorem_statement", "file_path", "commit", "repo_url", "initial_state", "full_name", "theorem_pos", "dojo_metadata", "imports", "template", "placeholder", "metadata")
SEED_REQUIRED = ("theorem_name", "theorem_statement")
CANDIDATE_REQUIRED = ("theorem_name",)
ACTION_SLOT = "__TACTIC__"
NEXT_ACTION = (
    "theorem_name", "theorem_statement", "state_before", "tactic", "state_after", "state_after_is_real", "proof_finished", "num_goals_before", "num_goals_after",
    "success", "backend", "verification_quality", "split", "source_record_hash",
)
EXAMPLES = ("theorem_name", "theorem_statement", "state_before", "tactic", "split")
VERDICTS = "cache_key string, theorem_statement string, success boolean, error string, elapsed_ms double"
PREDICTIONS = "row_id bigint, theorem_name string, theorem_statement string, state_before string, ground_truth_tactic string, split string, predictions array<string>"
