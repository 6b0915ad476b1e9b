"""Record layouts of the domain and the settings that drive a report."""

from __future__ import annotations

from dataclasses import dataclass, field

MODEL_REF = "struct<value:string,source:string,expression:string,env_var:string,defined_in:string>"
MESSAGES = "array<struct<role:string,content:string,resolved:boolean>>"
CALL_SITE = (
    f"id string, file string, line int, end_line int, function string, api string, model {MODEL_REF}, is_async boolean, messages {MESSAGES}, "
    "output_format string, temperature double, max_tokens int, via string, callers array<string>, notes array<string>, "
    "purpose string, output_contract string, difficulty string, grading string, found_by string"
)
SCAN_FILE = f"schema_version int, tool string, tool_version string, generated_by string, root string, summary struct<files_scanned:bigint>, warnings array<string>, call_sites array<struct<{CALL_SITE.replace(' string', ':string').replace(' int', ':int').replace(' double', ':double').replace(' boolean', ':boolean').replace(' array', ':array').replace(' struct', ':struct')}>>"
RESULT_ROW = (
    "case_id string, model string, output string, prompt_tokens bigint, completion_tokens bigint, latency_s double, score double, "
    "passed boolean, detail string, judge_score int, error string, judge_model string, run bigint, pos bigint"
)
#: Columns of an audited call site that a scanner can't fill. Fixed names.
ENRICHMENT = ["purpose", "output_contract", "difficulty", "grading"]
# Fixed values of the domain.
OUTPUT_FORMATS = ["text", "json"]
DIFFICULTIES = ["easy", "medium", "hard"]
GRADINGS = ["exact", "json_fields", "judge"]
PRODUCERS = ["ast", "auditor", "manual"]
MODEL_SOURCES = ["literal", "constant", "env_default", "env", "dict_lookup", "parameter_default", "kwargs", "dynamic", "missing"]
HOURS_PER_MONTH, DAYS_PER_MONTH = 730, 30
DEFAULT_COMPLETION_TOKENS = 256
JUDGE_EXTRA_PROMPT_TOKENS, JUDGE_COMPLETION_TOKENS = 150, 200
EPSILON = 1e-9
NEAR_MISS = 0.05
MIN_CASES = 20


@dataclass(frozen=True)
class Settings:
    """What a report is computed with; prices are USD per million tokens in and out."""

    baseline: str
    candidates: list[str]
    prices: dict[str, tuple[float, float]]
    threshold: float = 0.95
    floor: float = 0.0
    default_volume: int = 1000
    volumes: dict[str, int] = field(default_factory=dict)
    judge: str | None = None
    base_url: str = "http://localhost:11434/v1"
    api_key_env: str | None = None
    judge_url: str | None = None
    judge_key_env: str | None = None
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)

    @property
    def models(self) -> list[str]:
        """The baseline, then the candidates without it."""
        return [self.baseline, *(m for m in self.candidates if m != self.baseline)]

    def problems(self) -> list[str]:
        """Everything that is wrong, in the order of the settings."""
        out = []
        if not self.baseline:
            out.append("models.baseline must not be empty")
        if not self.candidates:
            out.append("models.candidates must not be empty")
        if len(set(self.candidates)) < len(self.candidates):
            out.append("models.candidates must be unique")
        if self.baseline in self.candidates:
            out.append("models.candidates must not hold the baseline")
        if not 0 < self.threshold <= 1:
            out.append(f"quality_threshold must be in (0, 1], got {self.threshold}")
        if not 0 <= self.floor <= 1:
            out.append(f"min_pass_rate must be in [0, 1], got {self.floor}")
        out += [f"pricing.{m} must not be negative" for m, p in self.prices.items() if min(p) < 0]
        out += [f"volume.{s} must be a whole number of 0 or more" for s, v in {"default_per_day": self.default_volume, **self.volumes}.items() if isinstance(v, bool) or not isinstance(v, int) or v < 0]
        if not self.base_url.startswith(("http://", "https://")):
            out.append("provider.base_url must start with http:// or https://")
        return out
