"""Long secrets are found whole."""

import random
import string

import pytest

from topiclog.llm import secret_scan as scan


@pytest.mark.parametrize("n", [300, 2000])
def test_long_tokens(n):
    value = "".join(random.Random(n).choices(string.ascii_letters + string.digits, k=n))
    for text, whole in ((f'and token = "{value}" the', value), (f"login token {value} the", value), (f"key sk_live_{value} in", f"sk_live_{value}"), (f"key xoxb-{value} in", f"xoxb-{value}")):
        (own,) = scan.findings([text], scan.default_forest())
        assert [text[a:b] for a, b, _, v in own if v >= 0.5] == [whole]
        assert value[-100:] not in scan.redact(text, [(a, b) for a, b, _, v in own if v >= 0.5])
