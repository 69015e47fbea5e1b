"""Settings: a YAML file, under it defaults, over it the environment."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, field, fields, replace
from pathlib import Path
from typing import Any

PREFIX = "SESSIONLOOM_"
TRUE = {"true", "1", "yes"}


# Names and defaults of settings, by which existing files are read.
@dataclass
class ModelConfig:
    model: str = "openai/gpt-oss-120b"
    max_tokens: int = 4096
    api_key: str = ""
    base_url: str = ""
    verify_ssl: bool = False
    proxy: str = ""
    proxy_bypass: str = ""
    timeout: float = 120.0
    connect_timeout: float = 10.0
    extra_headers: dict[str, str] = field(default_factory=dict)
    user_agent: str = "curl/8.0"

    @classmethod
    def of(cls, given: dict[str, Any], parent: ModelConfig | None = None) -> ModelConfig:
        """Given fields over the parent's, or over the defaults; unknown ones are ignored."""
        names = {f.name for f in fields(cls)}
        return replace(parent or cls(), **{k: v for k, v in given.items() if k in names and v is not None})


@dataclass
class SourceConfig:
    type: str = "sqlite"
    path: str = ""


@dataclass
class FilterConfig:
    min_messages: int = 5
    min_tools: int = 3
    projects: list[str] = field(default_factory=list)


@dataclass
class AnalysisConfig:
    clustering_min_size: int = 1
    clustering_max_topics: int = 8
    protected_topics: list[str] = field(default_factory=list)


@dataclass
class OutputConfig:
    skill_output_dir: str = "~/.sessionloom/skills"
    max_rules_per_skill: int = 15
    format: str = "skill_md"


@dataclass
class SchedulerConfig:
    enabled: bool = False
    cron: str = "0 3 * * *"


@dataclass
class Config:
    fast: ModelConfig = field(default_factory=ModelConfig)
    strong: ModelConfig = field(default_factory=ModelConfig)
    source: SourceConfig = field(default_factory=SourceConfig)
    filter: FilterConfig = field(default_factory=FilterConfig)
    analysis: AnalysisConfig = field(default_factory=AnalysisConfig)
    output: OutputConfig = field(default_factory=OutputConfig)
    scheduler: SchedulerConfig = field(default_factory=SchedulerConfig)


#: Environment names (after PREFIX) and the model field that each sets, in both models unless one is named.
ENVIRONMENT = {
    "API_KEY": "api_key", "BASE_URL": "base_url", "FAST_MODEL": "fast.model", "STRONG_MODEL": "strong.model", "VERIFY_SSL": "verify_ssl",
    "PROXY": "proxy", "PROXY_BYPASS": "proxy_bypass", "TIMEOUT": "timeout", "CONNECT_TIMEOUT": "connect_timeout",
}


def default_path() -> Path:
    return Path("~/.sessionloom/config.yaml").expanduser()


def _yaml():
    import yaml

    return yaml


def read_file(path: Path) -> dict:
    return (_yaml().safe_load(path.read_text(encoding="utf-8")) or {}) if path.exists() else {}


def _typed(kind: type, text: Any) -> Any:
    if kind is bool and isinstance(text, str):
        return text.strip().lower() in TRUE
    return kind(text)


def _section(cls, given: dict | None):
    names = {f.name for f in fields(cls)}
    return cls(**{k: v for k, v in (given or {}).items() if k in names and v is not None})


def load(path: Path | None = None, env: dict[str, str] | None = None) -> Config:
    """The strong model takes from the fast one what neither file nor environment gives it."""
    data = read_file(Path(path) if path else default_path())
    env = os.environ if env is None else env
    models = data.get("models") or {}
    fast, strong = dict(models.get("fast") or {}), dict(models.get("strong") or {})
    for name, target in ENVIRONMENT.items():
        if value := env.get(PREFIX + name):
            which, _, key = target.rpartition(".")
            value = _typed(type(getattr(ModelConfig(), key)), value)
            for side, given in (("fast", fast), ("strong", strong)):
                if which in ("", side):
                    given[key] = value
    first = ModelConfig.of(fast)
    out = Config(first, ModelConfig.of(strong, first), *[_section(cls, data.get(name)) for name, cls in (
        ("source", SourceConfig), ("filter", FilterConfig), ("analysis", AnalysisConfig), ("output", OutputConfig), ("scheduler", SchedulerConfig))])
    if kind := env.get(PREFIX + "SOURCE"):
        out.source.type = kind
    return out


def settable() -> dict[str, type]:
    """Dotted keys that can be set, and their types."""
    out = {f"{side}.{f.name}": type(getattr(ModelConfig(), f.name)) for side in ("fast", "strong") for f in fields(ModelConfig) if f.name != "extra_headers"}
    out |= {"filter.min_messages": int, "filter.min_tools": int, "analysis.clustering_min_size": int, "analysis.clustering_max_topics": int}
    out |= {"output.skill_output_dir": str, "output.max_rules_per_skill": int, "output.format": str, "scheduler.enabled": bool, "scheduler.cron": str, "source.type": str, "source.path": str}
    return out


def set_value(key: str, value: str, path: Path | None = None) -> None:
    """Write one typed value into an existing file."""
    path = Path(path) if path else default_path()
    if not path.exists():
        raise ValueError(f"there is no configuration at {path}; run init first")
    kinds = settable()
    if key not in kinds:
        raise ValueError(f"{key!r} cannot be set; keys are {', '.join(sorted(kinds))}")
    data = read_file(path)
    group, name = key.split(".")
    at = data.setdefault("models", {}).setdefault(group, {}) if group in ("fast", "strong") else data.setdefault(group, {})
    at[name] = _typed(kinds[key], value)
    path.write_text(_yaml().safe_dump(data, allow_unicode=True, sort_keys=False), encoding="utf-8")


def init(path: Path | None = None, api_key: str = "", **given: Any) -> Path:
    """A new file of both models, and the key in an .env file beside it that only the owner reads."""
    path = Path(path) if path else default_path()
    path.parent.mkdir(parents=True, exist_ok=True)
    fast_model, strong_model, kind = (given.pop(k, None) for k in ("fast_model", "strong_model", "source"))
    shared = {k: v for k, v in given.items() if v not in (None, "")}
    default = ModelConfig().model
    data = {
        "models": {"fast": {"model": fast_model or default, "max_tokens": 4096} | shared, "strong": {"model": strong_model or default, "max_tokens": 8192} | shared},
        **{k: asdict(v) for k, v in (("source", SourceConfig(kind or "sqlite")), ("filter", FilterConfig()), ("analysis", AnalysisConfig()), ("output", OutputConfig()), ("scheduler", SchedulerConfig()))},
    }
    path.write_text(_yaml().safe_dump(data, allow_unicode=True, sort_keys=False), encoding="utf-8")
    secret = path.with_name(".env")
    secret.write_text(f"{PREFIX}API_KEY={api_key}\n", encoding="utf-8")
    secret.chmod(0o600)
    return path


def read_env(path: Path) -> dict[str, str]:
    """NAME=value lines whose name has the prefix; comments and others are passed over."""
    out = {}
    if path.exists():
        for line in path.read_text(encoding="utf-8").splitlines():
            name, eq, value = line.strip().partition("=")
            if eq and name.strip().startswith(PREFIX):
                out[name.strip()] = value.strip()
    return out


def mask(text: str, visible: int = 4) -> str:
    return "(not set)" if not text else "*" * len(text) if len(text) <= visible else text[:visible] + "*" * (len(text) - visible)


def daily_time(cron: str) -> str:
    """H:MM of the first two fields of a cron line."""
    minute, hour = cron.split()[:2]
    return f"{hour}:{minute}"
