import sys

import pytest

from feedloom.operators.plugin import external_command

KEEP_GO = ("import sys, json\n"
           "for l in sys.stdin:\n"
           "    r = json.loads(l)\n"
           "    if 'go' in r.get('title', ''):\n"
           "        r['title'] = r['title'].upper(); print(json.dumps(r))\n")


def test_external_command_filters(make_items):
    df = make_items(dict(url="https://a/1", title="go"), dict(url="https://a/2", title="ruby"))
    out = external_command(df, sys.executable, ["-c", KEEP_GO]).collect()
    assert [(r.pos, r.title) for r in out] == [(0, "GO")]


def test_external_command_failure_reports_stderr(make_items):
    df = make_items(dict(url="https://a/1", title="go"))
    with pytest.raises(Exception, match="exit status 3: boom"):
        external_command(df, sys.executable, ["-c", "import sys; sys.stderr.write('boom'); sys.exit(3)"]).collect()


def test_external_command_timeout(make_items):
    df = make_items(dict(url="https://a/1", title="go"))
    with pytest.raises(Exception, match="timed out"):
        external_command(df, sys.executable, ["-c", "import time; time.sleep(5)"], timeout="200ms").collect()


def test_external_command_env(make_items):
    df = make_items(dict(url="https://a/1", title="x"))
    code = ("import sys, json, os\n"
            "for l in sys.stdin:\n"
            "    r = json.loads(l); r['title'] = os.environ['TAG']; print(json.dumps(r))\n")
    out = external_command(df, sys.executable, ["-c", code], env=["TAG=tagged"]).first()
    assert out.title == "tagged"
