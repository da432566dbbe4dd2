"""Spark-native kinematics and activity analytics."""
