"""Fixed values that file names, reports and results depend on."""

# --- fixed values: dataset types -> display name, artefact prefix ---
DATASETS = {
    "gsm": ("GSM8K", "GSM8K-in"),
    "sharegpt": ("ShareGPT", "ShareGPT-in"),
    "swebench": ("Swebench", "Swebench-in"),
}
DEFAULT_DATASET = "sharegpt"

# --- fixed values: report orders and defaults ---
DIFFICULTIES = ["easy", "medium", "hard"]
HUMAN = "human"
NO_ANSWER = "none"
FIRST_QUESTION_ID = 34602
SHEET_NAME_LENGTH = 31
MIN_AUTO_SAMPLES = 20
AUTO_SAMPLES_PER_SLOT = 10
MIN_COLD_SECONDS = 0.1
LATEST_RANK_LOG = "rank_0.log"
PERCENTILE_ROW = "99%"

# --- fixed values: patterns ---
NUMBER_PATTERN = r"-?\d+\.?\d*"
CONTROL_PATTERN = r"[\x00-\x08\x0b\x0c\x0e-\x1f]"
ACCEPTED_FIELD = "speculative_accepted_tokens"
PROPOSED_FIELD = "speculative_proposed_tokens"
THINK_END = "</think>"
ILLEGAL_NAME_CHARS = "[]:*?/\\"

# --- fixed values: visual and choice question rows ---
ANNOTATION = {
    "image_id": 0,
    "answer_type": "other",
    "question_type": "other",
    "answer_id": 1023,
    "answer": "None",
    "answer_confidence": "yes",
}
CHOICES = {"A": "win", "B": "or", "C": "lose", "D": "sss"}
CHOICE_ANSWER = "A"

# --- fixed values: metric table columns ---
METRIC_COLUMNS = [
    "param", "stage", "average", "min", "max", "median", "p75", "p90", "p99", "n",
]

# --- fixed values: metric parameters and common metrics of a case summary ---
SUMMARY_PARAMS = {
    "avg_e2el_ms": "E2EL",
    "avg_ttft_ms": "TTFT",
    "avg_tpot_ms": "TPOT",
    "avg_itl_ms": "ITL",
    "avg_output_tokens_per_s": "OutputTokenThroughput",
}
SUMMARY_COMMON = {
    "total_tokens_per_s": "Total Token Throughput",
    "requests_per_s": "Request Throughput",
    "total_requests": "Total Requests",
}

# --- fixed values: run summary keys -> column names ---
RUN_SUMMARY_KEYS = {
    "Number of concurrency": "concurrency",
    "Total requests": "requests",
    "Succeed requests": "succeed",
    "Failed requests": "failed",
    "Request throughput (req/s)": "request_throughput",
    "Output token throughput (tok/s)": "output_token_throughput",
    "Total token throughput (tok/s)": "total_token_throughput",
    "Average latency (s)": "avg_latency_s",
    "Average time to first token (s)": "avg_ttft_s",
    "Average time per output token (s)": "avg_tpot_s",
    "Average inter-token latency (s)": "avg_itl_s",
    "Average input tokens per request": "avg_input_tokens",
    "Average output tokens per request": "avg_output_tokens",
}
PERCENTILE_KEYS = {
    "Latency (s)": "p99_latency_s",
    "TTFT (s)": "p99_ttft_s",
    "TPOT (s)": "p99_tpot_s",
}
