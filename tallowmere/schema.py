"""Fixed vocabularies of the ledger."""

# Account types, categories, natures and the rules that assign them.
ACCOUNT_TYPES = ["savings", "current", "credit_card", "fd"]
#: Types that an account may be registered with.
KEPT_ACCOUNT_TYPES = ["savings", "current", "credit_card", "investment"]
CATEGORIES = ["food_dining", "groceries", "transport", "shopping", "entertainment", "utilities", "rent_housing", "health_medical", "education", "travel", "investments", "transfers", "insurance", "subscriptions", "income", "other"]
NOT_EXPENSE = ["income", "transfers", "investments"]
MERCHANTS = [("SWIGGY", "Swiggy", "rule:swiggy"), ("ZOMATO", "Zomato", "rule:zomato"), ("AMAZON", "Amazon", "rule:amazon"), ("ATM", "ATM Withdrawal", "rule:atm"), ("NEFT CR", "NEFT Credit", "rule:neft_credit"), ("NEFT-CR", "NEFT Credit", "rule:neft_credit"), ("IMPS", "IMPS Transfer", "rule:imps")]
CATEGORY_RULES = [("SWIGGY", "food_dining", "rule:swiggy"), ("ZOMATO", "food_dining", "rule:zomato"), ("AMAZON", "shopping", "rule:amazon"), ("UBER", "transport", "rule:uber"), ("OLA", "transport", "rule:ola"), ("NETFLIX", "subscriptions", "rule:netflix"), ("BIGBASKET", "groceries", "rule:bigbasket"), ("NEFT CREDIT", "income", "rule:neft_credit")]
NATURES = {"rent_housing": "essential_fixed", "insurance": "essential_fixed", "groceries": "essential_variable", "utilities": "essential_variable", "health_medical": "essential_variable", "education": "essential_variable", "food_dining": "discretionary", "entertainment": "discretionary", "shopping": "discretionary", "transport": "discretionary", "subscriptions": "discretionary", "travel": "luxury"}
# Basis points of a rule, and below which a model's answer isn't taken.
RULE_CONFIDENCE, MERCHANT_LEAST, CATEGORY_LEAST = 9500, 7000, 7500
NATURE_LEAST = 7500
# What a balance report says instead of a balance, and the statements' type that each account type goes with.
TYPE_MISSING, NOT_SUPPORTED, TYPE_MISMATCH = "account_type_missing", "balance_not_supported_for_account_type", "account_type_mismatch"
STATEMENT_UNREADABLE, ROW_UNREADABLE, LEDGER_BROKEN = "statement_decryption_failed", "transaction_decryption_failed", "ledger_integrity_error"
STATEMENT_TYPES = {"savings": "savings", "current": "savings", "credit_card": "credit_card"}

EXPENSE = [c for c in CATEGORIES if c not in NOT_EXPENSE]
