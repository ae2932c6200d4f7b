"""Fixed values.

These constants must equal the ones of the studied call-triage pipeline for the
labels and operating thresholds to come out the same.  They are stated as
plain text, in their original order, and are only defaults: every operator
takes its lists and thresholds as parameters.
"""

# --- fixed values: symptom vocabularies of the labelling rules ---------------
ARREST_SYMPTOM = "심정지"

EMERGENCY_SYMPTOMS = ['흉통', '절단', '압궤손상', '의식장애', '호흡곤란', '호흡정지', '경련/발작', '실신', '토혈', '혈변', '저체온증', '마비', '기도이물']
EMERGENCY_SYMPTOMS_GROUP1 = ['얼굴마비', '구음장애', '팔 위약/ 마비', '다리 위약/마비', '의식장애', '어지러움', '두통', '경련/발작', '실신']
EMERGENCY_SYMPTOMS_GROUP2 = ['흉통', '가슴불편감', '실신', '호흡곤란', '심계향진']
CARDIAC_SYMPTOMS = ['흉통', '가슴불편감', '실신', '호흡곤란', '심계향진']

# --- fixed values: slot count, split and resampling settings -----------------
MAX_SENTENCE = 117
SPLIT_SEED = 42
BOOTSTRAP_ROUNDS = 10
BOOTSTRAP_RATE = 0.75
SWEEP_POINTS = 512
VOCAB_TOP_K = 776

# --- fixed values: operating thresholds -------------------------------------
# (mode, time_cut_s, window, method) -> {model: threshold}, in original order.
OPERATING_THRESHOLDS = {
    ('2way', 120, 0, 'max'): {'Logistic Regression': 0.0296, 'XGBoost': 0.04822, 'Gradient Boosting': 0.04259, 'Random Forest': 0.02291},
    ('2way', 120, 0, 'average'): {'Logistic Regression': 0.04424, 'XGBoost': 0.04628, 'Gradient Boosting': 0.03231, 'Random Forest': 0.04250},
    ('2way', 120, 3, 'max'): {'Logistic Regression': 0.02979, 'XGBoost': 0.04299, 'Gradient Boosting': 0.031, 'Random Forest': 0.02228},
    ('2way', 120, 3, 'average'): {'Logistic Regression': 0.04424, 'XGBoost': 0.04628, 'Gradient Boosting': 0.02893, 'Random Forest': 0.04250},
    ('2way', 90, 0, 'max'): {'Logistic Regression': 0.0296, 'XGBoost': 0.04822, 'Gradient Boosting': 0.04259, 'Random Forest': 0.02291},
    ('2way', 90, 0, 'average'): {'Logistic Regression': 0.04424, 'XGBoost': 0.04628, 'Gradient Boosting': 0.03231, 'Random Forest': 0.04250},
    ('2way', 90, 3, 'max'): {'Logistic Regression': 0.02979, 'XGBoost': 0.04299, 'Gradient Boosting': 0.031, 'Random Forest': 0.02228},
    ('2way', 90, 3, 'average'): {'Logistic Regression': 0.04424, 'XGBoost': 0.04628, 'Gradient Boosting': 0.02893, 'Random Forest': 0.04250},
    ('2way', 60, 0, 'max'): {'Logistic Regression': 0.0296, 'XGBoost': 0.04822, 'Gradient Boosting': 0.04259, 'Random Forest': 0.02291},
    ('2way', 60, 0, 'average'): {'Logistic Regression': 0.04424, 'XGBoost': 0.04628, 'Gradient Boosting': 0.03231, 'Random Forest': 0.04250},
    ('2way', 60, 3, 'max'): {'Logistic Regression': 0.02979, 'XGBoost': 0.04299, 'Gradient Boosting': 0.031, 'Random Forest': 0.02228},
    ('2way', 60, 3, 'average'): {'Logistic Regression': 0.04424, 'XGBoost': 0.04628, 'Gradient Boosting': 0.02893, 'Random Forest': 0.04250},
    ('3way', 120, 0, 'max'): {'Logistic Regression': 0.02629, 'XGBoost': 0.02351, 'Gradient Boosting': 0.01879, 'Random Forest': 0.01402},
    ('3way', 120, 0, 'average'): {'Logistic Regression': 0.04424, 'XGBoost': 0.04628, 'Gradient Boosting': 0.02893, 'Random Forest': 0.04250},
    ('3way', 120, 3, 'max'): {'Logistic Regression': 0.03949, 'XGBoost': 0.03656, 'Gradient Boosting': 0.028, 'Random Forest': 0.01881},
    ('3way', 120, 3, 'average'): {'Logistic Regression': 0.03949, 'XGBoost': 0.03656, 'Gradient Boosting': 0.028, 'Random Forest': 0.01881},
    ('3way', 60, 0, 'max'): {'Logistic Regression': 0.04424, 'XGBoost': 0.04628, 'Gradient Boosting': 0.02893, 'Random Forest': 0.04250},
    ('3way', 60, 0, 'average'): {'Logistic Regression': 0.04424, 'XGBoost': 0.04628, 'Gradient Boosting': 0.02893, 'Random Forest': 0.04250},
    ('3way', 60, 3, 'max'): {'Logistic Regression': 0.0253, 'XGBoost': 0.0210, 'Gradient Boosting': 0.0173, 'Random Forest': 0.0139},
    ('3way', 60, 3, 'average'): {'Logistic Regression': 0.04424, 'XGBoost': 0.04628, 'Gradient Boosting': 0.02893, 'Random Forest': 0.04250},
    ('3way', 90, 0, 'max'): {'Logistic Regression': 0.04424, 'XGBoost': 0.02662, 'Gradient Boosting': 0.02893, 'Random Forest': 0.04250},
    ('3way', 90, 0, 'average'): {'Logistic Regression': 0.04424, 'XGBoost': 0.04628, 'Gradient Boosting': 0.02893, 'Random Forest': 0.04250},
    ('3way', 90, 3, 'max'): {'Logistic Regression': 0.0272, 'XGBoost': 0.0236, 'Gradient Boosting': 0.0206, 'Random Forest': 0.0147},
    ('3way', 90, 3, 'average'): {'Logistic Regression': 0.04424, 'XGBoost': 0.04628, 'Gradient Boosting': 0.02893, 'Random Forest': 0.04250},
}

# --- fixed values: accepted spellings of booleans ----------------------------
TRUE_STRINGS = ['yes', 'true', 't', 'y', '1']
FALSE_STRINGS = ['no', 'false', 'f', 'n', '0']
