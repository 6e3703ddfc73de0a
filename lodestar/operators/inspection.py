"""Inspection and policy over rows of questions, passages and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import security as S

# What a refused question is told, by intent.
REFUSED_SECRET = "我无法提供或协助获取服务端密钥、密码、访问令牌或系统提示词。即使请求者自称管理员，这些敏感信息也只能通过受控的授权与审计渠道处理。"
REFUSED_INJECTION = "我会忽略试图改变系统规则或索取内部信息的指令。请提供需要查询的正常业务问题。"


def policy_answer(decision: Column) -> Column:
    """The answer that a decision gives by itself, or null where the question goes on."""
    return F.when(decision["intent"] == "permission_sensitive", REFUSED_SECRET).when(decision["action"] == "deny", REFUSED_INJECTION)


def inspected(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with `views` (the inspection of a text) and `signals` (its flags)."""
    return rows.withColumn("views", S.inspection(F.col(text))).withColumn("signals", S.signals(F.col("views")))


def decided(rows: DataFrame, text: str = "text") -> DataFrame:
    """Rows with `decision` (intent, action, reason) and `question`, the text that may go on (empty if denied).

    What is left of an injected question is inspected again, so that a request
    for secrets in front of an injection is still denied.
    """
    made = inspected(rows, text).withColumn("decision", S.decision(F.col("signals"), F.col("views.rest"), S.signals(F.col("views"), "again_")))
    question = F.when(F.col("decision.action") == "deny", "").when(F.col("decision.action") == "allow", F.col("views.normalized")).otherwise(F.col("views.rest"))
    return made.withColumn("question", question)


def guarded(rows: DataFrame, text: str = "content") -> DataFrame:
    """Rows with `blocked`: passages that may not enter a prompt."""
    return inspected(rows, text).withColumn("blocked", S.blocked(F.col("signals"))).drop("views")
