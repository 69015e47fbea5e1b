"""Commands: init, distil, inspect, status, config, schedule."""

from __future__ import annotations

import argparse
import functools
import os
import subprocess
import sys
import time
from dataclasses import asdict
from datetime import UTC, datetime
from pathlib import Path

from . import config as C

VERSION = "0.1.0"


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser("sessionloom", description="Skills from coding sessions, on Spark.")
    p.add_argument("--version", action="version", version=VERSION)
    p.add_argument("--config", type=Path)
    sub = p.add_subparsers(dest="command", required=True)
    i = sub.add_parser("init", help="write a configuration")
    for name in ("api-key", "base-url", "fast-model", "strong-model", "source", "proxy", "proxy-bypass"):
        i.add_argument(f"--{name}", default="")
    i.add_argument("--verify-ssl", action="store_true")
    i.add_argument("--timeout", type=float)
    i.add_argument("--connect-timeout", type=float)
    d = sub.add_parser("distil", help="mine sessions and write skills")
    d.add_argument("-p", "--project")
    d.add_argument("-s", "--session")
    d.add_argument("--from", dest="since")
    d.add_argument("--to", dest="until")
    d.add_argument("--step", type=int, choices=(1, 2, 3))
    d.add_argument("--dry-run", action="store_true")
    d.add_argument("--incremental", action="store_true")
    d.add_argument("--offline", action="store_true", help="answer by rule, without a model")
    n = sub.add_parser("inspect", help="mine one session and show it")
    n.add_argument("session_id")
    n.add_argument("--offline", action="store_true")
    sub.add_parser("status", help="the last run and what was written")
    c = sub.add_parser("config").add_subparsers(dest="what", required=True)
    c.add_parser("show")
    s = c.add_parser("set")
    s.add_argument("key")
    s.add_argument("value")
    c.add_parser("edit")
    g = sub.add_parser("schedule")
    g.add_argument("what", choices=("start", "stop", "status"))
    return p


def _ms(day: str | None) -> int | None:
    return None if not day else int(datetime.fromisoformat(day).replace(tzinfo=UTC).timestamp() * 1000)


def _provider(m: C.ModelConfig):
    from .providers.http import HttpProvider

    return HttpProvider(m.model, m.api_key, m.base_url, m.proxy, m.proxy_bypass, m.verify_ssl, m.timeout, m.user_agent, m.extra_headers, m.connect_timeout)


def build(cfg: C.Config, offline: bool, **chosen):
    """A pipeline of a configuration; the fast model mines, clusters and merges, the strong one distils."""
    from .plans.analysis import ModelClusters
    from .plans.merging import model_merge
    from .plans.mining import Models
    from .plans.pipeline import Pipeline, Settings
    from .providers import RuleProvider
    from .session import get_session
    from .sources import create_source

    spark = get_session()
    out = os.path.expanduser(cfg.output.skill_output_dir)
    fast, strong = (RuleProvider, RuleProvider) if offline else (functools.partial(_provider, cfg.fast), functools.partial(_provider, cfg.strong))
    models = Models(fast, strong, f"{out}/.cache")
    settings = Settings(out, f"{out}/.work", projects=cfg.filter.projects, protected=cfg.analysis.protected_topics, min_messages=cfg.filter.min_messages, min_tools=cfg.filter.min_tools, form=cfg.output.format, max_rules=cfg.output.max_rules_per_skill, **chosen)
    clusters = ModelClusters(models, settings.project or "", cfg.analysis.clustering_min_size, cfg.analysis.clustering_max_topics)
    source = create_source(spark, cfg.source.type, os.path.expanduser(cfg.source.path), f"{out}/.sessions")
    return Pipeline(spark, source, models, settings, clusters, functools.partial(model_merge, models=models))


def _load(path: Path) -> C.Config:
    """The configuration with the .env file beside it, over which the environment goes."""
    return C.load(path, C.read_env(path.with_name(".env")) | dict(os.environ))


def _distil(cfg: C.Config, a: argparse.Namespace) -> int:
    run = build(cfg, a.offline, project=a.project, session_id=a.session, since_ms=_ms(a.since), until_ms=_ms(a.until), step=a.step, dry_run=a.dry_run)
    if a.incremental and hasattr(run.source, "changes") and not a.session:
        reports = run.run_changes()
    else:
        if a.incremental:
            run.settings.since_ms = run.state.since_ms()
        reports = [run.run()]
    for report in reports:
        print(report.note or "done", dict(report.labels), *(f"\n{k}: {v}" for k, v in report.paths.items()))
    if not reports:
        print("nothing new")
    return 0


def _inspect(cfg: C.Config, a: argparse.Namespace) -> int:
    report = build(cfg, a.offline, session_id=a.session_id, step=1, dry_run=True).run()
    for r in report.session_rows:
        print(*(f"{k}: {v}" for k, v in r.items()), sep="\n")
    print(report.note, *report.usage, sep="\n")
    return 0


def _status(cfg: C.Config) -> int:
    from .session import get_session
    from .sinks.state import StateStore

    out = os.path.expanduser(cfg.output.skill_output_dir)
    state = StateStore(get_session(), f"{out}/state")
    held = state.load()
    print(f"last run: {held['last_run'] or 'never'}\nprocessed: {state.processed().count()}\ncost: {held['cost_accumulated']}")
    for p in sorted(Path(out).glob("*/*/SKILL.md")):
        print(p, p.stat().st_size)
    return 0


def _config(cfg: C.Config, a: argparse.Namespace, path: Path) -> int:
    if a.what == "show":
        for group, values in asdict(cfg).items():
            print(f"[{group}]")
            for k, v in values.items():
                print(f"  {k}: {C.mask(v) if k == 'api_key' else v}")
    elif a.what == "set":
        C.set_value(a.key, a.value, path)
    else:
        subprocess.run([os.environ.get("EDITOR", "vi"), str(path)], check=False)
    return 0


def _schedule(cfg: C.Config, a: argparse.Namespace, path: Path) -> int:
    if a.what == "status":
        print(f"enabled: {cfg.scheduler.enabled}, daily at {C.daily_time(cfg.scheduler.cron)}")
    elif a.what == "stop":
        print("stop the process that runs 'schedule start'")
    elif not cfg.scheduler.enabled:
        print("the scheduler is not enabled: config set scheduler.enabled true")
        return 1
    else:
        hour, minute = map(int, C.daily_time(cfg.scheduler.cron).split(":"))
        ran = None
        while True:
            now = datetime.now()
            if (now.hour, now.minute) >= (hour, minute) and ran != now.date():
                ran = now.date()
                _distil(_load(path), _parser().parse_args(["distil", "--incremental"]))
            time.sleep(60)
    return 0


def main(argv: list[str] | None = None) -> int:
    a = _parser().parse_args(argv)
    path = a.config or C.default_path()
    if a.command == "init":
        given = {k: getattr(a, k) for k in ("base_url", "fast_model", "strong_model", "source", "proxy", "proxy_bypass", "timeout", "connect_timeout")}
        print(C.init(path, a.api_key, verify_ssl=a.verify_ssl or None, **given))
        return 0
    cfg = _load(path)
    try:
        return {"distil": lambda: _distil(cfg, a), "inspect": lambda: _inspect(cfg, a), "status": lambda: _status(cfg), "config": lambda: _config(cfg, a, path), "schedule": lambda: _schedule(cfg, a, path)}[a.command]()
    except (ValueError, FileNotFoundError) as e:
        print(e, file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
