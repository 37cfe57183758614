"""Row schemas of the data model as Spark DDL."""

BLOCKS = (
    "device_id bigint, block_idx bigint, ts timestamp, voiced boolean, energy double"
)
FRAMES = "utt_id bigint, model string, frame_idx bigint, logits array<double>"
PHRASES = (
    "device_id bigint, phrase_id bigint, start_idx bigint, end_idx bigint, "
    "start_ts timestamp, end_ts timestamp, n_blocks bigint, duration_s double, "
    "rms double, end_reason string"
)
WAKE_DECISIONS = (
    "device_id bigint, phrase_id bigint, ts timestamp, is_final boolean, "
    "detected boolean, wake_text string, score double"
)
JOURNAL = (
    "event string, schema_version int, attempt_id string, prompt_id string, "
    "speech_label string, target_text string, filename string, sha256 string, "
    "duration_seconds double, rms double, wake_text string, status string, "
    "reference_text string, reason string, error string, utc string, "
    "line bigint, ts timestamp"
)
_CTC = "struct<" + ", ".join(
    f"{n}: double"
    for n in (
        "mean_non_blank_confidence",
        "min_non_blank_confidence",
        "non_blank_entropy",
        "uncertain_non_blank_ratio",
        "blank_prediction_ratio",
        "mean_blank_probability",
        "non_blank_token_rate",
    )
) + ">"
RESULTS = (
    "event string, status string, prompt_id string, sha256 string, attempt_id string, "
    "reference_text string, text string, route string, entropy_delta double, "
    f"ctc struct<bulgarian: {_CTC}, english: {_CTC}>, "
    "word_error struct<errors: int, reference_words: int, wer: double>, "
    "elapsed_seconds double, first_inference boolean, completed bigint, failed bigint"
)
DATASET_MANIFEST = (
    "filename string, label string, prompted_text string, duration_seconds double, "
    "rms double, wake_text string"
)
EVIDENCE_CSV = (
    "sample int, filename string, ground_truth string, prompted_text string, "
    "duration_seconds double, rms double, wake_text string, entropy_delta double, "
    "current_prediction string, current_correct boolean"
)
TELEMETRY = (
    "ts timestamp, phase string, label string, used_mb double, total_mb double, elapsed_s double"
)
