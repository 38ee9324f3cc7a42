"""The advertised languages, any of which pairs with any other."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Code, English name, own name.
LANGUAGES = (
    ("af", "Afrikaans", "Afrikaans"), ("ar", "Arabic", "العربية"), ("bg", "Bulgarian", "Български"), ("bn", "Bengali", "বাংলা"),
    ("ca", "Catalan", "Català"), ("cs", "Czech", "Čeština"), ("da", "Danish", "Dansk"), ("de", "German", "Deutsch"),
    ("el", "Greek", "Ελληνικά"), ("en", "English", "English"), ("es", "Spanish", "Español"), ("et", "Estonian", "Eesti"),
    ("eu", "Basque", "Euskara"), ("fa", "Persian", "فارسی"), ("fi", "Finnish", "Suomi"), ("fr", "French", "Français"),
    ("gl", "Galician", "Galego"), ("he", "Hebrew", "עברית"), ("hi", "Hindi", "हिन्दी"), ("hr", "Croatian", "Hrvatski"),
    ("hu", "Hungarian", "Magyar"), ("id", "Indonesian", "Bahasa Indonesia"), ("is", "Icelandic", "Íslenska"), ("it", "Italian", "Italiano"),
    ("ko", "Korean", "한국어"), ("lt", "Lithuanian", "Lietuvių"), ("lv", "Latvian", "Latviešu"), ("mk", "Macedonian", "Македонски"),
    ("ms", "Malay", "Bahasa Melayu"), ("nl", "Dutch", "Nederlands"), ("no", "Norwegian", "Norsk"), ("pl", "Polish", "Polski"),
    ("pt", "Portuguese", "Português"), ("ro", "Romanian", "Română"), ("ru", "Russian", "Русский"), ("sk", "Slovak", "Slovenčina"),
    ("sl", "Slovenian", "Slovenščina"), ("sq", "Albanian", "Shqip"), ("sr", "Serbian", "Српски"), ("sv", "Swedish", "Svenska"),
    ("sw", "Swahili", "Kiswahili"), ("tl", "Tagalog", "Tagalog"), ("tr", "Turkish", "Türkçe"), ("uk", "Ukrainian", "Українська"),
    ("ur", "Urdu", "اردو"), ("vi", "Vietnamese", "Tiếng Việt"), ("zh-Hans", "Simplified Chinese", "简体中文"), ("zh-Hant", "Traditional Chinese", "繁體中文"),
)


def tokenizer_of(code: str) -> str:
    return "jieba" if code.startswith("zh") else "unicode-regex"


def languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(c, n, o, tokenizer_of(c)) for c, n, o in LANGUAGES], "code string, name string, native_name string, tokenizer string")
