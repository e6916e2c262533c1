"""Raw fields of a bar panel as expression values."""

from quantspark.functions.expr import field, pct

OPEN, HIGH, LOW, CLOSE = field("open"), field("high"), field("low"), field("close")
VOLUME, AMOUNT, TURNOVER = field("volume"), field("amount"), field("turnover")
RET = pct(CLOSE, 1)
