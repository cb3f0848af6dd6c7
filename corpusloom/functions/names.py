"""Name tables. Fixed values that results depend on; pass your own tables to the jobs to extend them."""

# --- fixed values ---------------------------------------------------------------------------------------------
KOREAN_SURNAMES = {
    "김": "Kim", "이": "Lee", "박": "Park", "최": "Choi", "정": "Jung", "강": "Kang", "조": "Cho", "윤": "Yoon",
    "장": "Jang", "임": "Lim", "한": "Han", "신": "Shin", "오": "Oh", "서": "Seo", "권": "Kwon",
}
KOREAN_HANJA_SURNAMES = {
    "金": "Kim", "李": "Lee", "朴": "Park", "崔": "Choi", "郑": "Jung", "鄭": "Jung", "姜": "Kang", "赵": "Cho",
    "趙": "Cho", "尹": "Yoon", "张": "Jang", "張": "Jang", "林": "Lim", "韩": "Han", "韓": "Han", "申": "Shin",
    "吴": "Oh", "吳": "Oh", "徐": "Seo", "权": "Kwon", "權": "Kwon",
}
KOREAN_FULL_NAMES = {
    "朴智星": "Park Ji-sung", "金秀贤": "Kim Soo-hyun", "金秀賢": "Kim Soo-hyun", "李敏镐": "Lee Min-ho",
    "李敏鎬": "Lee Min-ho",
}
JAPANESE_PREFIXES = {
    "宇智波": "Uchiha", "漩涡": "Uzumaki", "日向": "Hyuga", "大筒木": "Otsutsuki", "千手": "Senju",
    "波风": "Namikaze", "春野": "Haruno", "旗木": "Hatake",
}
JAPANESE_GIVEN_NAMES = {"佐助": "Sasuke", "鸣人": "Naruto", "鳴人": "Naruto", "健": "Takeru"}
JAPANESE_FULL_NAMES = {"佐藤健": "Sato Takeru"}
KNOWN_ALIASES = {
    "培特": ["Bồi Đặc"], "诺文": ["Nặc Văn"], "蕾娜": ["Lôi Na"], "莫尼": ["Mạc Ni"], "布兰登": ["Bố Lan Đăng"],
    "格林": ["Cách Lâm"], "雷亚克": ["Lôi Á Khắc", "Reyak", "Reak"], "普兰蒂斯": ["Lan Đế Tư", "Plandis"],
    "帝释天": ["Đế Thách Thiên"], "罗伯特": ["La Bá Đặc"], "墨菲": ["Mặc Phỉ"], "德思礼": ["Đức Tư Lễ"],
}
CANONICAL_TARGETS = {
    "Cách Lâm": "Green", "Bồi Đặc": "Pette", "Nặc Văn": "Norwin", "Lôi Na": "Lena", "Mạc Ni": "Moni",
    "Bố Lan Đăng": "Brandon", "Lôi Á Khắc": "Reyak", "Lan Đế Tư": "Plandis", "La Bá Đặc": "Robert",
    "Mặc Phỉ": "Murphy", "Đức Tư Lễ": "Dursley", "Mã Lệ": "Mary", "Y Mã": "Emma", "Vi Đức": "Wade",
    "An Na": "Anna", "Ốc Tư": "Woods", "Ba Đồ": "Batu", "Mễ Á": "Mia", "A Nhĩ Toa": "Elsa", "Ái Nhĩ Toa": "Elsa",
    "Ngải Nhĩ Sa": "Elsa", "Nifflerr": "Niffler", "Niffle": "Niffler",
}
READING_OVERRIDES = {"释": "Thích"}
UNIVERSE_MARKERS = {
    "木叶": "naruto", "火影": "naruto", "宇智波": "naruto", "查克拉": "naruto", "斯塔克": "marvel",
    "神盾局": "marvel", "复仇者": "marvel", "霍格沃茨": "harry_potter", "伏地魔": "harry_potter",
    "恶魔果实": "one_piece", "海贼王": "one_piece",
}
NAME_SUFFIXES = ("刚就也会能想要在到了着过" "手头脚腿脸眼嘴心魂身" "剑刀枪棍印鼎钟塔镜")
CHARACTER_TYPES = ("character", "name")
GLOSSARY_TYPES = ("sect", "location", "item", "entity", "universe")
# --- end of fixed values --------------------------------------------------------------------------------------


def name_rows() -> list[tuple[str, int, str, str]]:
    """All name tables as rows (kind, order, key, value)."""
    tables = {
        "korean_surname": KOREAN_SURNAMES, "hanja_surname": KOREAN_HANJA_SURNAMES, "korean_full": KOREAN_FULL_NAMES,
        "japanese_prefix": JAPANESE_PREFIXES, "japanese_given": JAPANESE_GIVEN_NAMES,
        "japanese_full": JAPANESE_FULL_NAMES,
    }
    return [(kind, i, key, value) for kind, t in tables.items() for i, (key, value) in enumerate(t.items())]
