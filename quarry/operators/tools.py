"""Tool calls that a message holds as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def mine_tool_calls(messages: DataFrame, key: str) -> DataFrame:
    """(key, n, tool, args) of messages (key, text): <invoke> elements with parameters, and name({...}) with a JSON object.

    Braces are balanced outside strings, which patterns can't do; each message is small and goes through one function.
    """

    def calls(text: str) -> list[tuple[int, str, str]]:
        import json
        import re

        out = []
        for m in re.finditer(r'<invoke name="([^"]+)">(.*?)</invoke>', text, re.S):
            out.append((m.start(), m[1], json.dumps(dict(re.findall(r'<parameter name="([^"]+)">(.*?)</parameter>', m[2], re.S)))))
        decoder = json.JSONDecoder()
        for m in re.finditer(r"([A-Za-z_]\w*)\((?=\{)", text):
            try:
                value, end = decoder.raw_decode(text, m.end())
            except ValueError:
                continue
            if text[end : end + 1] == ")":
                out.append((m.start(), m[1], json.dumps(value)))
        return sorted(out)

    def part(frames):
        import pandas as pd

        for f in frames:
            rows = [(k, n, tool, args) for k, t in zip(f[key], f["text"], strict=True) if isinstance(t, str) for n, (_, tool, args) in enumerate(calls(t))]
            yield pd.DataFrame(rows, columns=[key, "n", "tool", "args"])

    return messages.select(key, "text").mapInPandas(part, f"{key} long, n int, tool string, args string")
