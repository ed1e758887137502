"""Word lists of the article rules: fixed values, whole and in order."""

#: Names of markets.
FOREIGN_MARKETS = [
    "indonesia", "indonesian", "印度尼西亚", "印尼", "greece", "greek", "希腊", "india", "indian", "印度", "thailand", "thai", "泰国", "vietnam", "vietnamese", "越南", "malaysia", "malaysian",
    "马来西亚", "singapore", "singaporean", "新加坡", "philippines", "philippine", "菲律宾", "usa", "u.s.", "united states", "american", "美国", "uk", "united kingdom", "britain", "british",
    "英国", "europe", "european", "欧洲", "germany", "german", "德国", "france", "french", "法国", "italy", "italian", "意大利", "spain", "spanish", "西班牙", "korea", "south korea", "korean",
    "韩国", "china", "chinese", "中国", "hong kong", "香港", "taiwan", "台湾", "australia", "australian", "澳大利亚", "canada", "canadian", "加拿大", "brazil", "brazilian", "巴西", "mexico",
    "mexican", "墨西哥", "turkey", "turkish", "土耳其", "uae", "dubai", "阿联酋", "迪拜", "saudi", "saudi arabia", "沙特",
]

#: Launches, and the goods they are about.
LAUNCHES = [
    "launch", "launches", "launched", "release", "released", "introduce", "introduced", "introduces", "debut", "debuts", "unveil", "unveils", "new product", "new item", "推出",
    "发布", "上市", "上新", "発売", "新発売", "新商品", "新产品", "新作",
]
PRODUCTS = [
    "product", "item", "sku", "collection", "collaboration", "capsule", "phone", "smartphone", "bag", "shoe", "shoes", "cosmetic", "cosmetics", "beauty", "lipstick", "snack",
    "toy", "model", "series", "merch", "merchandise", "单品", "商品", "款式", "系列", "联名", "新品",
]

#: Offers of single goods, kinds of goods, promotions of a whole site.
SINGLE_PROMOS = [
    "deal", "deals", "sale", "on sale", "discount", "coupon", "special price", "flash sale", "price drop", "markdown", "cheap", "cheaper", "lowest price", "good deal", "bargain",
    "promo", "promotion", "offer", "limited offer", "特价", "特価", "优惠", "優惠", "折扣", "值", "便宜", "好价", "好價", "促销", "促銷", "优惠价", "優惠價", "値下げ", "安い", "お得", "セール", "タイムセール", "クーポン",
    "期間限定", "特別価格",
]
SINGLE_CATEGORIES = [
    "earphone", "earphones", "earbud", "earbuds", "headphone", "headphones", "speaker", "camera", "action camera", "smartwatch", "watch", "tablet", "laptop", "notebook", "pc",
    "monitor", "tv", "television", "projector", "router", "keyboard", "mouse", "microphone", "console", "game", "vacuum", "fan", "air fryer", "fridge", "coffee maker", "printer",
    "bag", "shoe", "shoes", "sneaker", "shirt", "jacket", "coat", "dress", "cosmetic", "cosmetics", "skincare", "lipstick", "serum", "cream", "toy", "figure", "lego", "snack",
    "drink", "bottle", "protein", "supplement", "diaper", "stroller", "furniture", "耳机", "耳機", "耳塞", "耳麦", "耳麥", "相机", "相機", "运动相机", "運動相機", "手表", "手錶", "平板", "笔记本", "筆記本", "电脑",
    "電腦", "显示器", "顯示器", "电视", "電視", "投影", "键盘", "鍵盤", "鼠标", "滑鼠", "麦克风", "麥克風", "游戏机", "遊戲機", "吸尘器", "吸塵器", "风扇", "風扇", "冰箱", "咖啡机", "咖啡機", "打印机", "印表機", "包", "鞋", "球鞋", "服饰",
    "服飾", "外套", "裙", "化妆品", "化妝品", "护肤", "護膚", "口红", "口紅", "玩具", "积木", "積木", "零食", "饮料", "飲料", "奶粉", "纸尿裤", "紙尿褲", "婴儿车", "嬰兒車", "家具", "イヤホン", "ヘッドホン", "スピーカー", "カメラ", "アクションカメラ",
    "スマートウォッチ", "腕時計", "タブレット", "ノートpc", "ノートパソコン", "モニター", "テレビ", "プロジェクター", "キーボード", "マウス", "マイク", "ゲーム機", "掃除機", "扇風機", "冷蔵庫", "コーヒーメーカー", "プリンター", "バッグ", "シューズ", "スニーカー",
    "ジャケット", "コート", "ワンピース", "化粧品", "スキンケア", "口紅", "玩具", "おもちゃ", "菓子", "飲料", "家具",
]
BROAD_PROMOS = [
    "sitewide", "all users", "all products", "across the site", "platform-wide", "shopping event", "membership day", "prime day", "black friday", "cyber monday", "double 11",
    "double 12", "11.11", "12.12", "coupon campaign", "point campaign", "points up", "cashback event", "festival campaign", "全站", "全场", "全場", "全品类", "全品類", "平台活动", "平台活動", "大促",
    "满减", "滿減", "购物节", "購物節", "黑五", "雙11", "双11", "雙12", "双12", "优惠券活动", "優惠券活動", "积分活动", "積分活動", "返现活动", "返現活動", "全商品", "全ショップ", "全カテゴリ", "サイト全体", "全会員", "全會員", "大型セール",
    "ポイントアップ", "ポイント還元", "プライムデー", "ブラックフライデー", "サイバーマンデー", "メガ割", "スーパーsale", "お買い物マラソン",
]

#: What touches all users of a platform.
MATERIAL_IMPACT = [
    "policy", "rule", "terms", "fee", "fees", "shipping", "delivery", "logistics", "return", "refund", "customer service", "support", "coupon", "discount", "promotion", "price",
    "pricing", "payment", "checkout", "search", "recommendation", "algorithm", "app", "feature", "service", "sitewide", "all users", "livestream", "live shopping", "authentic",
    "counterfeit", "quality", "seller policy", "platform rule", "政策", "规则", "条款", "费用", "运费", "物流", "配送", "退货", "退款", "客服", "售后", "优惠券", "折扣", "促销", "价格", "支付", "搜索", "推荐", "算法",
    "功能", "服务", "直播", "正品", "假货", "质量",
]

#: Words of trade that, with the ones above, make a platform's context; sports that make noise.
TRADE_CONTEXT = [
    "ec", "ecommerce", "e-commerce", "online shop", "online store", "marketplace", "shopping", "shop", "mall", "retail", "merchant", "seller", "buyer", "consumer",
    "official store", "app store", "cart", "order", "coupon", "points", "bank", "wallet", "security", "fraud", "通販", "电商", "電商", "购物", "購物", "网购", "網購", "商家", "卖家", "賣家", "买家",
    "買家", "用户", "用戶", "消费者", "消費者", "商城", "店铺", "店鋪", "网店", "網店", "官方店", "购物车", "購物車", "订单", "訂單", "积分", "積分", "支付安全", "不正利用", "セキュリティ", "不正", "不正利用", "決済", "通販サイト", "オンラインショップ",
    "オンラインストア", "ショッピング", "モール", "出店", "購入", "注文", "楽天市場", "amazon.co.jp", "tiktok shop", "live commerce", "ライブコマース",
]
NOISY_TOPICS = [
    "baseball", "soccer", "football", "basketball", "volleyball", "tennis", "golf", "boxing", "pitcher", "batter", "home run", "match", "tournament", "coach", "goal", "player",
    "league", "赛马", "比赛", "球员", "球队", "联赛", "投手", "打者", "本垒打", "野球", "野球部", "サッカー", "バスケ", "バレー", "テニス", "ゴルフ", "ボクシング", "試合", "大会", "選手", "監督", "打線", "先発", "登板", "本塁打", "プロ野球",
]

#: Signs of promotions and of reports.
PROMO_SIGNALS = [
    "sale", "discount", "coupon", "campaign", "promotion", "promo", "deal", "deals", "special offer", "limited offer", "limited time", "limited-time", "price cut", "markdown",
    "clearance", "reward", "rewards", "points", "point up", "point boost", "point campaign", "point back", "cashback", "offer", "offers", "festival", "shopping event",
    "flash sale", "bundle", "voucher", "セール", "フェア", "期間限定", "特典", "割引", "値引", "値下げ", "クーポン", "キャンペーン", "特価", "ポイント", "ポイントアップ", "ポイント還元", "還元", "优惠", "折扣", "促销", "活动", "优惠券",
    "满减", "double 11", "double 12", "11.11", "12.12", "black friday", "cyber monday", "prime day", "boxing day", "holiday sale", "seasonal sale", "spring sale", "summer sale",
    "winter sale", "new year sale", "christmas", "valentine", "white day", "mothers day", "father's day", "back to school", "bonus season", "gift", "gifting", "shopping festival",
    "shopping season", "festival campaign", "年末年始", "初売り", "新春", "福袋", "ゴールデンウィーク", "gw", "母の日", "父の日", "敬老の日", "クリスマス", "年末", "年始", "お盆", "バレンタイン", "ホワイトデー", "新生活", "新生活応援",
    "入学", "卒業", "夏休み", "冬休み", "双11", "双十二", "双12", "618", "节日", "節日", "节庆", "節慶", "礼物", "禮物", "送礼", "送禮", "消费季", "消費期",
]
REPORT_SIGNALS = [
    "ranking", "rankings", "rank", "benchmark", "report", "survey", "study", "index", "data", "stats", "market share", "leaderboard", "comparison", "comparative", "classment",
    "classement", "rapport", "barometre", "baromètre", "etude", "étude", "donnees", "données", "comparatif", "palmares", "palmarès", "排名", "榜单", "报告", "数据", "调查", "指数", "统计",
    "市占率", "ランキング", "レポート", "調査", "データ", "指標",
]

#: Substrings of news about a whole platform.
PLATFORM_LEVEL = [
    "prime day", "black friday", "cyber monday", "spring deal", "deal days", "shopping festival", "membership", "loyalty", "points", "cashback", "payment", "checkout",
    "cash payment", "delivery", "shipping", "return", "refund", "privacy", "data", "security", "safety", "investigation", "illegal", "counterfeit", "compliance", "pfas", "seller",
    "merchant", "commission", "policy", "marketplace", "algorithm", "recommendation", "app", "feature", "trend", "report", "survey", "study", "market share", "penetration",
    "adoption", "consumer behavior", "consumers use", "growth", "social commerce", "ecommerce growth", "brand performance", "market performance", "customer experience",
    "consumer experience", "consumer trust", "complaints", "satisfaction", "regulation", "regulator", "antitrust", "consumer protection", "creator economy", "retail media",
    "platform ecosystem", "pagamento", "pagamenti", "contanti", "consegna", "spedizione", "reso", "rimborso", "privacy", "dati", "sicurezza", "indagine", "illegale", "venditore",
    "venditori", "commissioni", "regole", "mercato", "social commerce", "shopping su instagram", "rapporto", "ricerca", "studio", "dati", "tendenza", "crescita", "consumatori",
    "quota di mercato", "esperienza cliente", "esperienza di acquisto", "fiducia", "soddisfazione", "reclami", "inchiesta", "tutela dei consumatori",
]

#: Groups of trend terms.
TREND_REGULATORY = [
    "regulation", "regulatory", "investigation", "probe", "illegal", "compliance", "privacy", "data", "counterfeit", "unsafe", "pfas", "eu", "commission", "authority",
    "antitrust", "indagine", "inchiesta", "illegale", "privacy", "dati", "sicurezza", "contraffazione", "sostanze", "autorità", "commissione europea", "accusa", "accuse",
]
TREND_MARKET = [
    "market share", "penetration", "adoption", "1 in", "one in", "consumers use", "consumer use", "e-commerce", "ecommerce", "social commerce", "growth", "grows", "market",
    "trend", "report", "survey", "study", "data", "stats", "index", "mercato", "crescita", "consumatori", "rapporto", "ricerca", "studio", "dati", "tendenza", "trend",
    "classifica", "quota", "adozione", "penetrazione",
]
TREND_PERFORMANCE = [
    "sales", "revenue", "gmv", "growth", "decline", "loss", "profit", "expands", "expansion", "vendite", "ricavi", "fatturato", "crescita", "calo", "espansione",
]
TREND_ECOSYSTEM = [
    "seller", "merchant", "marketplace", "logistics", "delivery", "shipping", "payment", "checkout", "creator", "creators", "shop", "business tools", "platform tools",
    "ecosystem", "venditori", "merchant", "marketplace", "logistica", "spedizioni", "pagamenti", "creator", "strumenti", "ecosistema",
]
TREND_CONSUMER = [
    "consumer behavior", "shoppers", "consumer", "customers", "usage", "users", "gen z", "comportamento", "consumatori", "clienti", "utenti", "acquisti", "shopping",
]
TREND_COMPETITIVE = [
    "competitor", "competition", "versus", "vs", "ranking", "rankings", "comparison", "benchmark", "concorrente", "concorrenza", "classifica", "confronto", "comparazione",
    "benchmark",
]
TREND_MARKET_FIRST = [
    "penetration", "adoption", "1 in", "one in", "consumers use", "consumer use", "survey", "study", "report", "data", "stats", "adozione", "penetrazione", "consumatori",
    "rapporto", "ricerca", "studio", "dati",
]

#: Strong and weak signs of trade on a photo network, with those of one language; noise of its accounts.
SHOP_STRONG = [
    "Instagram Shop", "Instagram Shopping", "Instagram ecommerce", "Instagram social commerce", "Instagram creator shop", "Instagram checkout", "Meta shopping tools",
    "Meta commerce", "Meta commerce tools", "Meta business tools", "Meta ads commerce", "social commerce", "creator shop", "reels shopping", "shoppable posts", "checkout",
]
SHOP_STRONG_IT = [
    "shopping su Instagram", "acquisti su Instagram", "comprare su Instagram", "negozio Instagram", "social commerce Italia", "shopping nei Reels", "post acquistabili",
]
SHOP_WEAK = [
    "Instagram business", "Instagram business tools", "Meta commerce", "Meta commerce tools", "Meta business tools", "Meta ads commerce", "creator economy", "brand partnership",
    "creator marketplace", "shoppable posts", "reels shopping", "business tools", "small business", "merchant", "advertising", "ads", "commerce",
]
SHOP_WEAK_IT = ["creator economy Italia", "strumenti business Instagram", "piccole imprese", "commercianti", "pubblicità"]
SHOP_ENTERTAINMENT = [
    "celebrity", "singer", "actor", "actress", "concert", "music", "movie", "film", "reality", "tv show", "serie tv", "musica", "concerto", "attore", "attrice", "cantante", "vip",
    "influencer gossip", "gossip",
]
SHOP_ACCOUNTS = [
    "post", "posts", "photo", "photos", "story", "stories", "account", "profile", "followers", "like", "likes", "comment", "comments", "reel", "reels", "foto", "storie",
    "profilo", "follower", "seguaci", "commenti",
]

#: Signs of an impact on all of Europe, of a video shop's ecosystem, of events of several platforms.
UNION_IMPACT = [
    "EU", "European Union", "European Commission", "Europe", "European", "DSA", "Digital Services Act", "consumer protection", "consumer rights", "customs", "low value parcel",
    "low-value parcels", "de minimis", "online marketplace", "platform regulation", "product safety", "privacy", "data protection", "GDPR", "investigation", "compliance",
    "counterfeit", "illegal products", "market share", "growth",
]
UNION_IMPACT_IT = [
    "Unione Europea", "Commissione europea", "Europa", "protezione consumatori", "tutela dei consumatori", "dogane", "pacchi di basso valore", "marketplace online",
    "sicurezza prodotti", "privacy", "dati personali", "indagine", "inchiesta", "conformità", "contraffazione", "prodotti illegali",
]
VIDEO_SHOP = [
    "TikTok Shop", "social commerce", "live shopping", "live commerce", "creator economy", "creator marketplace", "seller", "sellers", "merchant", "merchants", "marketplace",
    "payment", "delivery", "shipping", "return", "refund", "consumer protection", "regulation", "compliance", "privacy", "data", "product safety",
]
VIDEO_SHOP_IT = [
    "acquisti su TikTok", "negozio TikTok", "venditore", "venditori", "commercianti", "pagamento", "consegna", "spedizione", "reso", "rimborso", "tutela consumatori",
    "conformità", "sicurezza",
]
MULTI_PLATFORM = [
    "Shein", "SHEIN", "AliExpress", "Chinese marketplace", "Chinese marketplaces", "Chinese platforms", "Chinese ecommerce", "piattaforme cinesi", "marketplace cinesi",
    "ecommerce cinese", "Shein e Temu", "AliExpress, Shein, Temu",
]
