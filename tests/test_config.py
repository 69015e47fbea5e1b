import pytest

from sessionloom import cli
from sessionloom import config as C


def test_defaults_and_inheritance(tmp_path):
    assert C.load(tmp_path / "none.yaml", {}).fast.model == "openai/gpt-oss-120b"
    path = tmp_path / "c.yaml"
    path.write_text("models:\n  fast: {model: a, api_key: k, proxy: p, timeout: 99}\n  strong: {model: b}\noutput: {max_rules_per_skill: 20, format: knowledge_md}\nanalysis: {clustering_min_size: 3}\n")
    c = C.load(path, {})
    assert (c.strong.model, c.strong.api_key, c.strong.proxy, c.strong.timeout) == ("b", "k", "p", 99)
    assert (c.output.max_rules_per_skill, c.output.format, c.analysis.clustering_min_size) == (20, "knowledge_md", 3)
    c = C.load(path, {"SESSIONLOOM_API_KEY": "e", "SESSIONLOOM_VERIFY_SSL": "yes", "SESSIONLOOM_STRONG_MODEL": "s", "SESSIONLOOM_SOURCE": "files"})
    assert (c.fast.api_key, c.strong.api_key, c.fast.verify_ssl, c.fast.model, c.strong.model, c.source.type) == ("e", "e", True, "a", "s", "files")


def test_set_and_init(tmp_path):
    path = tmp_path / "x" / "c.yaml"
    with pytest.raises(ValueError, match="init"):
        C.set_value("fast.model", "m", path)
    C.init(path, "key", base_url="http://u", strong_model="s")
    assert C.read_env(path.with_name(".env")) == {"SESSIONLOOM_API_KEY": "key"}
    C.set_value("fast.model", "m", path)
    C.set_value("filter.min_tools", "7", path)
    c = C.load(path, {})
    assert (c.fast.model, c.strong.model, c.filter.min_tools, c.fast.base_url, c.strong.max_tokens) == ("m", "s", 7, "http://u", 8192)
    for key in ("bogus.field", "fast.extra_headers"):
        with pytest.raises(ValueError, match="cannot be set"):
            C.set_value(key, "x", path)


def test_show_masks_keys(tmp_path, capsys):
    path = tmp_path / "c.yaml"
    C.init(path, "")
    C.set_value("fast.api_key", "sk-secret-key-12345", path)
    assert cli.main(["--config", str(path), "config", "show"]) == 0
    out = capsys.readouterr().out
    assert "sk-s***" in out and "secret-key" not in out
    assert cli.main(["--config", str(path), "schedule", "status"]) == 0
    assert "3:0" in capsys.readouterr().out


def test_environment_file(tmp_path):
    path = tmp_path / ".env"
    path.write_text("# SESSIONLOOM_X=1\nSESSIONLOOM_API_KEY = k\nOTHER=2\n")
    assert C.read_env(path) == {"SESSIONLOOM_API_KEY": "k"}


def test_every_command_reads_the_key(tmp_path, monkeypatch):
    """Scheduled runs too: all load the configuration in one place."""
    path = tmp_path / "c.yaml"
    C.init(path, "from-file")
    monkeypatch.delenv("SESSIONLOOM_API_KEY", raising=False)
    assert cli._load(path).strong.api_key == "from-file"
    monkeypatch.setenv("SESSIONLOOM_API_KEY", "from-environment")
    assert cli._load(path).fast.api_key == "from-environment"
    C.set_value("fast.user_agent", "agent/1", path)
    C.set_value("fast.connect_timeout", "3", path)
    assert (cli._load(path).fast.user_agent, cli._load(path).fast.connect_timeout) == ("agent/1", 3.0)
    asked = []

    def run(cfg, a):
        asked.append((cfg.fast.api_key, a.incremental))
        raise KeyboardInterrupt

    monkeypatch.setattr(cli, "_distil", run)
    C.set_value("scheduler.enabled", "true", path)
    C.set_value("scheduler.cron", "0 0 * * *", path)
    with pytest.raises(KeyboardInterrupt):
        cli.main(["--config", str(path), "schedule", "start"])
    assert asked == [("from-environment", True)]
