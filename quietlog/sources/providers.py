"""Provider dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Provider key, name, coding URL, general URL, ordered models.
PROVIDERS = (
    ("zhipu", "智谱 GLM", "https://open.bigmodel.cn/api/coding/paas/v4", "https://open.bigmodel.cn/api/paas/v4",
     ["glm-4-flash", "glm-4-plus", "glm-4-air", "glm-4-long", "glm-4"]),
    ("zhipu_v2", "智谱 GLM (api.z.ai)", "https://api.z.ai/api/coding/paas/v4", "https://api.z.ai/api/paas/v4",
     ["glm-4-flash", "glm-4-plus", "glm-4-air", "glm-4-long", "glm-4", "glm-4.7", "glm-5"]),
    ("aliyun", "阿里云百炼", "https://dashscope.aliyuncs.com/compatible-mode/v1",
     "https://dashscope.aliyuncs.com/compatible-mode/v1",
     ["qwen-turbo", "qwen-plus", "qwen-max", "qwen2.5-coder-32b-instruct"]),
    ("minimax", "MiniMax", "https://api.minimax.chat/v1", "https://api.minimax.chat/v1",
     ["abab6.5s-chat", "abab6.5g-chat", "abab6.5-chat"]),
    ("deepseek", "DeepSeek", "https://api.deepseek.com/v1", "https://api.deepseek.com/v1",
     ["deepseek-chat", "deepseek-coder"]),
    ("moonshot", "Moonshot (Kimi)", "https://api.moonshot.cn/v1", "https://api.moonshot.cn/v1",
     ["moonshot-v1-8k", "moonshot-v1-32k", "moonshot-v1-128k"]),
    ("custom", "自定义服务商", "", "", []),
)


def providers(spark: SparkSession) -> DataFrame:
    """Seven fixed rows, so broadcasting them is always safe."""
    return spark.createDataFrame(
        [tuple(p) for p in PROVIDERS],
        "provider string, name string, coding_base_url string, general_base_url string, models array<string>",
    )
