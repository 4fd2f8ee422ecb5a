"""Names of strokes: their classes and the commands that draw them."""

from __future__ import annotations

# The names of each class; the fifth has the turning strokes.
CLASSES = {
    1: "横 提".split(),
    2: "竖 竖钩".split(),
    3: "撇 平撇".split(),
    4: "点 平点 捺 平捺 挑捺".split(),
    5: "横钩 横撇 横折 横折钩 横斜钩 横折提 横折折 横折弯 横撇弯钩 横折弯钩 横斜弯钩 横折折撇 横折折折 横折折折钩 竖提 竖折 竖弯 竖弯左 竖弯钩 竖折撇 竖折折钩 竖折折 撇点 撇折 弯钩 斜钩 撇钩 卧钩 圈 特殊笔画".split(),
}
# The names drawn by each sequence of commands.
DRAWN = {
    "h": "横 提 横钩".split(), "v": "竖 竖钩 弯钩".split(), "c": "撇 点 捺 斜钩 撇钩 卧钩 特殊笔画".split(), "z": "平撇 平点 平捺".split(), "a": ["圈"],
    "hc": "挑捺 横撇 横斜钩 横斜弯钩".split(), "hv": "横折 横折钩".split(), "hvh": "横折提 横折折 横折弯 横折弯钩".split(), "hcv": ["横撇弯钩"], "hvhc": ["横折折撇"], "hvhv": "横折折折 横折折折钩".split(),
    "vh": "竖提 竖折 竖弯 竖弯左 竖弯钩".split(), "vhc": ["竖折撇"], "vhv": "竖折折钩 竖折折".split(), "cc": ["撇点"], "ch": ["撇折"],
}
#: Names that count as another when roots are looked for.
DEGENERATE = {"提": "横", "捺": "点"}

CLASS_OF = {name: k for k, names in CLASSES.items() for name in names}
COMMANDS_OF = {name: tuple(commands) for commands, names in DRAWN.items() for name in names}


def classifier(own: dict[str, int] | None = None) -> dict[str, int]:
    """All classes; a configuration's own win."""
    return CLASS_OF | (own or {})


def valid(stroke: dict) -> bool:
    """Whether a stroke is drawn as its name demands."""
    return COMMANDS_OF.get(stroke["feature"]) == tuple(c for c, _ in stroke["curves"])
